"""Visible text of web pages, laid out: a tree builder with implied tags drives a renderer.

The builder keeps the stack of open elements, opens and closes what the markup leaves out (paragraphs, list
items, table rows and cells, the head), and ignores end tags that match nothing. The renderer keeps a stack of
flows: a list item and a table cell have a flow of their own, whose lines go into the flow around it when they
close. Both are loops over tokens, so depth of nesting is not bound by the interpreter's stack. Lines that go up a
level are not copied unless they change, and tables are aligned as long as the padding stays in proportion to their
text, so a page costs about its own length, however deep its tables.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TELLING = re.compile(r"hidden|display|visibility|colspan|rowspan|start|value", re.I)
_NO_BOX = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset(
    "head title script style template noscript iframe noembed noframes object audio video canvas svg math datalist".split()
)
OF_HEAD = frozenset("base link meta title script style template noscript head html".split())
#: Blocks that start on a new line; those with a margin are set off by an empty line.
PLAIN_BLOCKS = frozenset(
    "address article aside body center details dialog dd div dt fieldset footer form header hgroup html legend main nav "
    "optgroup option search section summary li caption".split()
)
MARGIN_BLOCKS = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul figcaption xmp".split())
ENDS_PARAGRAPH = (PLAIN_BLOCKS | MARGIN_BLOCKS) - {"option", "optgroup", "body", "html", "caption", "legend"}
#: What a start tag closes, and where the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "caption"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "caption", "tr"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption", "tr"}, {"table"}),
}
SCOPE = frozenset({"table", "td", "th", "caption", "button", "template", "object"})
#: A table is aligned as long as it has at most this many characters for each of its text and its cells. Beyond it,
#: cells wider than NARROW get out of line, and if that is not enough, its cells are written one below the other.
PADDING = 64
NARROW = 60
#: Lists deeper than this are not indented further.
DEEPEST_INDENT = 40
#: The widest and the longest cell that HTML knows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Lines:
    """Lines with their lengths added up. Of two joined parts the longer one is not copied.

    ``own`` counts the characters that come from the page, without padding.
    """

    def __init__(self):
        self.rows: deque[str] = deque()
        self.size = self.widest = self.own = 0

    def append(self, line: str, own: int | None = None) -> None:
        self.rows.append(line)
        self.size += len(line)
        self.widest = max(self.widest, len(line))
        self.own += len(line) if own is None else own

    def join(self, other: _Lines) -> None:
        """Take over the lines of ``other``, which is not used afterwards."""
        if len(other.rows) > len(self.rows):
            other.rows.extendleft(reversed(self.rows))
            self.rows = other.rows
        else:
            self.rows.extend(other.rows)
        self.size += other.size
        self.widest = max(self.widest, other.widest)
        self.own += other.own

    def marked(self, mark: str, indent: bool) -> _Lines:
        """The lines behind a list mark, the others as far to the right as the first."""
        if not indent:
            self.rows[0] = mark + self.rows[0]
            self.size += len(mark)
            self.own += len(mark)
            self.widest = max(self.widest, len(self.rows[0]))
            return self
        out, room = _Lines(), " " * len(mark)
        for i, line in enumerate(self.rows):
            out.append((room if i else mark) + line if line else line, 0)
        out.own = self.own + len(mark)
        return out


class _Flow:
    """Lines of one context; inline text waits until a line ends."""

    def __init__(self):
        self.lines = _Lines()
        self.inline: list[str] = []
        self.gap = False

    def end_line(self) -> None:
        if self.inline:
            text = _SPACES.sub(" ", "".join(self.inline)).strip(" ").replace("\xa0", " ")
            self.inline = []
            if text:
                self.set_off(False)
                self.lines.append(text)

    def set_off(self, margin: bool) -> None:
        if (self.gap or margin) and self.lines.rows:
            self.lines.append("")
        self.gap = margin

    def add(self, lines: _Lines, margin: bool = False) -> None:
        self.end_line()
        if lines.rows:
            self.set_off(margin)
            self.lines.join(lines)

    def block(self, margin: bool) -> None:
        self.end_line()
        self.gap |= margin

    def new_line(self) -> None:
        """A forced break: an empty line when nothing waits."""
        if "".join(self.inline).strip():
            self.end_line()
            return
        self.inline = []
        if self.lines.rows and self.lines.rows[-1] != "":
            self.lines.append("")
            self.gap = False


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[_Lines, int, int]]] = []
        self.group = 0
        self.groups: list[int] = []

    def start_row(self) -> None:
        self.rows.append([])
        self.groups.append(self.group)

    def _places(self) -> list[list[tuple[int, int, _Lines]]] | None:
        """(first column, column behind, lines) of each cell; a cell of several rows keeps its columns in all of them.

        None when finding the places is out of proportion to the number of cells.
        """
        last = list(range(len(self.rows)))
        for r in range(len(self.rows) - 2, -1, -1):
            if self.groups[r] == self.groups[r + 1]:
                last[r] = last[r + 1]
        held: list[tuple[int, int, int]] = []
        placed, work, cells = [], 0, 0
        for r, row in enumerate(self.rows):
            places: list[tuple[int, int, _Lines]] = []
            placed.append(places)
            if not row:
                continue
            work += len(held)
            cells += len(row)
            if work > PADDING * (cells + 100):
                return None
            held = [h for h in held if h[2] >= r]
            new, at, i = [], 0, 0
            for lines, across, down in row:
                while i < len(held) and held[i][0] <= at:
                    at = max(at, held[i][1])
                    i += 1
                places.append((at, at + across, lines))
                end = min(r + down - 1, last[r]) if down else last[r]
                if end > r:
                    if new and new[-1][1:] == (at, end):
                        new[-1] = (new[-1][0], at + across, end)
                    else:
                        new.append((at, at + across, end))
                at += across
            if new:
                held = sorted(held + new)
        return placed

    def layout(self) -> _Lines:
        """Rows with their cells side by side, each column starting at one place in all rows."""
        columns: list[int] = []
        placed = None
        if any(len(row) > 1 or (row and row[0][2] != 1) for row in self.rows):
            placed = self._places()
        if placed is not None:
            columns = sorted({at for row in placed for at, _, _ in row})
        if len(columns) > 1:
            cells = [
                [(bisect_left(columns, at), bisect_left(columns, end), lines) for at, end, lines in row] for row in placed
            ]
            own = sum(lines.own + 1 for row in cells for _, _, lines in row)
            for most in (None, NARROW):
                start = self._starts(cells, len(columns), most)
                size = sum(
                    max(len(lines.rows) for _, _, lines in row) * (start[row[-1][0]] + 1)
                    + sum(lines.size for _, _, lines in row) for row in cells if row
                )
                if size <= PADDING * (own + 16):
                    return self._aligned(cells, start)
        out = _Lines()
        for row in self.rows:
            for lines, _, _ in row:
                out.join(lines)
        return out

    @staticmethod
    def _starts(cells, n: int, most: int | None) -> list[int]:
        """Where each column starts: behind every cell that ends before it."""
        ending = defaultdict(list)
        for row in cells:
            for first, end, lines in row:
                if most is None or lines.widest <= most:
                    ending[end].append((first, lines.widest))
        start = [0]
        for column in range(1, n):
            start.append(max([start[-1], *(start[first] + wide for first, wide in ending[column])]) + 3)
        return start

    @staticmethod
    def _aligned(cells, start: list[int]) -> _Lines:
        out = _Lines()
        for row in cells:
            parts = [(start[first], iter(lines.rows)) for first, _, lines in row]
            for _ in range(max((len(lines.rows) for _, _, lines in row), default=0)):
                line = ""
                for at, rest in parts:
                    text = next(rest, "")
                    line = f"{line.ljust(at - 3)} | {text}" if at else text
                out.append(line.rstrip(" "), 0)
            out.own += sum(lines.own for _, _, lines in row)
        return out


class Page:
    def __init__(self):
        self.open: list[tuple[str, object, bool]] = []
        #: Where the open elements of a name are in ``open``.
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.unseen = 0
        #: Whether the visibility that is inherited hides text.
        self.veiled = False
        self.preformatted = 0
        self.flows = [_Flow()]
        self.lists: list[list] = []
        self.tables: list[_Table] = []

    # tree builder

    def start(self, name: str, rest: str) -> None:
        if name in ("html", "body") and self.at[name]:
            return
        if self.at["head"] and name not in OF_HEAD:
            self._close_to("head")
        if name in CLOSES:
            names, stop = CLOSES[name]
            self._close_any(names, stop)
        if name in ("td", "th") and self.at["table"] and not self._within("tr", "table"):
            self._push("tr", {})
        elif name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") and not self.at["table"]:
            return
        if name in ENDS_PARAGRAPH and self.at["p"]:
            self._close_any({"p"}, SCOPE)
        attributes = {}
        if rest and _TELLING.search(rest):
            for key, a, b, c in _ATTRIBUTE.findall(rest):
                attributes.setdefault(key.lower(), html.unescape(a or b or c))
        if name in VOID:
            self._void(name, attributes)
        else:
            self._push(name, attributes)

    def end(self, name: str) -> None:
        if name == "br":
            self._void("br", {})
        elif name == "p" and not self.at["p"]:
            self._block(True)
        elif self.at[name]:
            stop = SCOPE if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else {"table"}
            if self.at[name][-1] > self._nearest(stop - {name}):
                self._pop_to(self.at[name][-1])

    def _nearest(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of ``names``, or -1."""
        return max((self.at[n][-1] for n in names if self.at[n]), default=-1)

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            self._pop()

    def _within(self, name: str, stop: str) -> bool:
        return self._nearest((name,)) > self._nearest((stop,))

    def _close_any(self, names: set[str], stop: set[str]) -> None:
        """Close the outermost element of ``names`` below the nearest ``stop``."""
        if not any(self.at[n] for n in names):
            return
        border = self._nearest({*stop, "table"})
        inside = [self.at[n][bisect_right(self.at[n], border)] for n in names if self._nearest((n,)) > border]
        if inside:
            self._pop_to(min(inside))

    def _close_to(self, name: str) -> None:
        while self.at[name]:
            self._pop()

    def finish(self) -> str:
        while self.open:
            self._pop()
        self.flows[0].end_line()
        return "\n".join(x.rstrip(" ") for x in self.flows[0].lines.rows).strip("\n")

    # renderer

    def text(self, raw: str) -> None:
        if self.unseen or self.veiled or not raw:
            return
        if self.at["head"] and raw.strip():
            self._close_to("head")
        if self.tables and self.open and self.open[-1][0] in ("table", "tr", "tbody", "thead", "tfoot") and not raw.strip():
            return
        text = html.unescape(raw)
        if self.preformatted:
            first, *others = text.replace("\r\n", "\n").split("\n")
            self.flows[-1].inline.append(first)
            for line in others:
                self._keep_line()
                self.flows[-1].inline.append(line)
        else:
            self.flows[-1].inline.append(text)

    def _keep_line(self) -> None:
        flow = self.flows[-1]
        line, flow.inline = "".join(flow.inline).rstrip(" "), []
        if line or flow.lines.rows:
            flow.set_off(False)
            flow.lines.append(line)

    def _block(self, margin: bool) -> None:
        if not self.unseen:
            if self.preformatted:
                self._keep_line()
            self.flows[-1].block(margin)

    def _void(self, name: str, attributes: dict) -> None:
        if self.unseen:
            return
        if name == "hr":
            self._block(True)
        elif self.veiled:
            return
        elif name == "br":
            self.flows[-1].new_line()
        elif name == "input" and "hidden" not in (attributes.get("type", ""), *attributes) and attributes.get("value"):
            self.flows[-1].inline.append(f" {attributes['value']} ")

    def _push(self, name: str, attributes: dict) -> None:
        style = attributes.get("style", "")
        unseen = name in UNSEEN or "hidden" in attributes or bool(_NO_BOX.search(style))
        self.at[name].append(len(self.open))
        if unseen or self.unseen:
            self.unseen += 1
            self.open.append((name, None, self.veiled))
            return
        veiled = self.veiled
        for value in _VISIBILITY.findall(style):
            self.veiled = value.lower() in ("hidden", "collapse")
        note: object = name
        if name in MARGIN_BLOCKS or name in PLAIN_BLOCKS:
            nested = name in ("ul", "ol", "menu") and self.lists
            self._block(name in MARGIN_BLOCKS and not nested)
        if name in ("ul", "ol", "menu"):
            first = attributes.get("start", "1")
            self.lists.append([name == "ol", int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1])
        elif name == "li":
            number = attributes.get("value", "")
            if self.lists and self.lists[-1][0]:
                if re.fullmatch(r"-?\d{1,9}", number):
                    self.lists[-1][1] = int(number)
                note = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            else:
                note = "- "
            if self.veiled:
                note = ""
            self.flows.append(_Flow())
        elif name == "table":
            self.tables.append(_Table())
            note = self.lists
            self.lists = []
        elif name == "tr":
            self.tables[-1].start_row()
        elif name in ("tbody", "thead", "tfoot"):
            self.tables[-1].group += 1
        elif name in ("td", "th"):
            across, down = (attributes.get(x, "").strip() for x in ("colspan", "rowspan"))
            note = (
                min(int(across), MOST_COLUMNS) if re.fullmatch(r"[1-9]\d{0,8}", across) else 1,
                min(int(down), MOST_ROWS) if re.fullmatch(r"\d{1,9}", down) else 1,
            )
            self.flows.append(_Flow())
        elif name in ("pre", "textarea", "xmp"):
            self.preformatted += 1
        elif name == "q" and not self.veiled:
            self.flows[-1].inline.append('"')
        self.open.append((name, note, veiled))

    def _pop(self) -> None:
        name, note, before = self.open.pop()
        self.at[name].pop()
        if self.unseen:
            self.unseen -= 1
            return
        if name in ("pre", "textarea", "xmp"):
            if self.flows[-1].inline != [""]:
                self._keep_line()
            self.flows[-1].inline = []
            self.preformatted -= 1
        elif name == "li":
            own = self.flows.pop()
            own.end_line()
            if own.lines.rows:
                self.flows[-1].add(own.lines.marked(note, len(self.lists) <= DEEPEST_INDENT) if note else own.lines)
        elif name in ("td", "th"):
            own = self.flows.pop()
            own.end_line()
            self.tables[-1].rows[-1].append((own.lines, *note))
        elif name == "table":
            self.lists = note
            self.flows[-1].add(self.tables.pop().layout(), True)
        elif name in ("ul", "ol", "menu"):
            self.lists.pop()
        elif name == "q" and not self.veiled:
            self.flows[-1].inline.append('"')
        self.veiled = before
        if name in MARGIN_BLOCKS or name in PLAIN_BLOCKS:
            self._block(name in MARGIN_BLOCKS and not (name in ("ul", "ol", "menu") and self.lists))


def visible_text(page: str | None) -> str:
    """The text that a reader of the page sees, with its block spacing, lists and tables."""
    page = page or ""
    out, at = Page(), 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            out.text(page[at:])
            return out.finish()
        out.text(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            out.end(name)
            continue
        out.start(name, m["rest"] or m["rest2"] or "")
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            out.text(page[at : close.start()] if close else page[at:])
            at = close.end() if close else len(page)
            out.end(name)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_lines.

    A null or empty page, and one with nothing visible, has the empty text and 0 lines. Ids and urls are passed on as they
    are, repeated or null; other columns are ignored; an empty table gives an empty result. Pages are read whole. What has no
    box (``display:none``, ``hidden``) goes with all it holds; ``visibility`` is inherited, so a visible element in a hidden
    one is kept. Cells over several rows or columns keep their place; see PADDING and DEEPEST_INDENT for pages whose
    padding would outgrow their text, which lose alignment but no text.
    """

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [visible_text(x) for x in frame["html"]]
            yield pd.DataFrame({
                "page_id": frame["page_id"], "url": frame["url"], "text": text,
                "n_lines": [x.count("\n") + 1 if x else 0 for x in text],
            })

    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_lines long"
    return pages.select("page_id", "url", "html").mapInPandas(render, schema)
