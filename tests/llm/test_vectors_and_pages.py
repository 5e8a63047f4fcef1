"""Operators on vectors and pages next to plain versions of what they promise."""

import time
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tabloom.llm import lattice, multi_index
from tabloom.llm.components import components
from tabloom.llm.html_text import extract, visible_text

VECTORS = "vec_id long, embedding array<float>, label int, id long, h1 string, key int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    rows = [rng.normal(size=16) for _ in range(500)]
    for i in range(80):
        rows.append(rows[i % 9] + rng.normal(size=16) * 0.08)
    rows += [rows[1] * 2, rows[2], rows[2], rows[2]]
    rows = [(i, [float(x) for x in np.float32(v)], i % 3, i, "x", 1) for i, v in enumerate(rows)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] + [1.0] * 15, [1.0, 2.0, 3.0]]
    return rows + [(n + i, v, None, None, None, None) for i, v in enumerate(odd)] + [(None, rows[3][1], 1, 1, "", 1), rows[40], rows[40]]


def sound(rows, length=16):
    return {r[0]: np.array(r[1]) for r in rows if r[0] is not None and r[1] and len(r[1]) == length and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}


def test_lattice_links_all_near_vectors(spark, vectors):
    own = sound(vectors)
    ids = list(own)
    x = np.stack([own[i] / np.linalg.norm(own[i]) for i in ids])
    near = x @ x.T >= 0.9
    rows = lattice.near_vectors(spark.createDataFrame(vectors, VECTORS)).collect()
    assert len(rows) == len(vectors)
    links, parent = {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}, {i: i for i in ids}
    for _ in ids:
        parent = {i: min(parent[ids[j]] for j in np.flatnonzero(near[k])) for k, i in enumerate(ids)}
    assert sum(links.values()) > 500
    for r in rows:
        root = parent.get(r.vec_id, r.vec_id)
        assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), root, root == r.vec_id or r.vec_id is None)


def test_lattice_links_vectors_of_any_magnitude(spark):
    """Doubles whose squares overflow or vanish link as the same directions do at length 1."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    near = base + 0.02 * rng.normal(size=base.shape)
    scales = [1e200, 1e-200, 1.0, 1e300, 1e-300, 1e-310]
    x = np.concatenate([base * np.resize(scales, 12)[:, None], near * np.resize(scales[::-1], 12)[:, None]])
    plain = np.concatenate([base, near])
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    linked = plain @ plain.T >= 0.9
    rows = lattice.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.n_links for r in rows} == {i: int(linked[i].sum()) - 1 for i in range(24)}
    assert all(linked[i, i + 12] for i in range(12))


def test_lattice_blocks_and_empty_tables(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS)
    whole = sorted(map(str, lattice.near_vectors(df).collect()))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lattice, "BLOCK", 7)
        assert sorted(map(str, lattice.near_vectors(df).collect())) == whole
    assert lattice.near_vectors(df.limit(0)).collect() == []
    assert lattice.near_vectors(df.where("embedding IS NULL")).collect()[0].n_links == 0


def test_decoder_finds_the_nearest_lattice_point():
    assert len({tuple(v) for v in lattice.minimal_vectors()}) == 240 and (lattice.minimal_vectors() ** 2).sum(1).tolist() == [8] * 240
    x = np.random.default_rng(0).normal(size=(200, 8)) * 2
    got = ((x - lattice.decode(x)) ** 2).sum(1)
    best = np.full(len(x), np.inf)
    for half in (0.0, 0.5):
        base = np.floor(x - half) + half
        for step in product((0, 1), repeat=8):
            p = base + step
            even = ((p - half).sum(1) + (0 if half == 0 else 8 * 0)) % 2 == 0
            best = np.where(even, np.minimum(best, ((x - p) ** 2).sum(1)), best)
    assert np.allclose(got, best)


def test_components_of_chains_stars_and_rings(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 600)] + [(900 + i, 900 + (i + 1) % 30) for i in range(30)] + [(7, 7)]
    edges = [(int(a), int(b)) for a, b in rng.permutation([e if rng.random() < 0.5 else e[::-1] for e in edges + edges[:20]])]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 0 for i in range(1, 101)} | {i: 500 for i in range(501, 600)} | {i: 900 for i in range(901, 930)}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_multi_index_finds_the_nearest(spark, vectors):
    own = sound(vectors)
    ids = np.array(sorted(own))
    x = np.stack([own[i] for i in ids])
    df = spark.createDataFrame(vectors, VECTORS)
    rows = multi_index.search(df, every=5, k=20).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 5 == 0}
    for q, hits in got.items():
        scores = (x * own[q]).sum(1)
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
        assert [h[0] for h in hits] == ids[order].tolist() and np.allclose([h[1] for h in hits], scores[order])


def test_multi_index_recall_with_few_candidates(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(multi_index, "BLOCK", 300)
        rows = multi_index.search(df, candidates=600, centroids=16).collect()
    hits = total = 0
    for q in range(0, 3000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        top = set(np.argsort(-scores)[:20].tolist())
        hits += len(top & {r.vec_id for r in rows if r.query_id == q})
        total += 20
    assert len(rows) == total and hits / total >= 0.9


def test_multi_index_recall_above_the_least_budget(spark):
    """Evenly spread unit vectors, five times as many as the smallest budget of candidates."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, 64, dtype=np.int32), x.ravel())
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": flat}))
    found = {}
    for r in multi_index.search(df, every=2000).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 2000):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(-scores, 20)[:20].tolist()))
    print("recall", hits / 1200)
    assert sum(map(len, found.values())) == 1200 and hits / 1200 >= 0.94


def test_heap_order_is_that_of_sorted_sums():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b, counts = rng.normal(size=6), rng.normal(size=9), rng.integers(0, 4, (6, 9))
        sums = (a[:, None] + b).ravel()
        order = np.argsort(-sums)
        for enough in (1, 5, 20, 10_000):
            held = np.cumsum(counts.ravel()[order])
            expected = sums[order[np.searchsorted(held, enough)]] if held[-1] >= enough else -np.inf
            assert multi_index.last_sum(a, b, counts, enough) == expected


def test_cells_fill_spans_of_bounded_size():
    """Cells share a span up to its size and no further; a larger cell is cut into spans of its own."""
    counts = np.array([3, 0, 4, 2, 5, 0, 1, 25, 2, 9])
    first, parts = multi_index.laid_out(counts, 10)
    held = {}
    for n, at, cut in zip(counts.tolist(), first.tolist(), parts.tolist()):
        for i in range(cut):
            held[at + i] = held.get(at + i, 0) + n / cut
    assert [first[i] for i in (0, 2, 3, 4, 6, 7, 8, 9)] == [0, 0, 0, 1, 1, 2, 5, 6] and parts[7] == 3
    assert max(held.values()) <= 10 and sum(held.values()) == counts.sum()


def test_best_of_blocks_is_the_best_of_all():
    """Block by block as at once, with many equal products, entries not seen and fewer entries than asked for."""
    rng = np.random.default_rng(7)
    for size, k in ((500, 21), (12, 21)):
        x, q = rng.integers(-2, 3, (size, 6)).astype(float), rng.integers(-2, 3, (9, 6)).astype(float)
        ids, seen = rng.permutation(size), rng.random((9, size)) < 0.8
        seen[3] = False
        best = multi_index._Best(q, k)
        for at in range(0, size, 64):
            here = slice(at, at + 64)
            best.add(np.where(seen[:, here], q @ x[here].T, -np.inf), ids[here], x[here])
        for r in range(9):
            expected = sorted((-float((x[i] * q[r]).sum()), int(ids[i])) for i in np.flatnonzero(seen[r]))[:k]
            found = np.isfinite(best.scores[r])
            assert list(zip((-best.scores[r][found]).tolist(), best.ids[r][found].tolist())) == expected


def test_multi_index_small_tables(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (40, [2.0, 1.0]), (60, [3.0]), (80, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in multi_index.search(df).collect())
    assert got == [(0, 1, 40, 2.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (20, 1, 40, 2.0), (20, 2, 0, 1.0), (20, 3, 3, 1.0), (40, 1, 0, 2.0), (40, 2, 3, 2.0), (40, 3, 20, 2.0)]
    assert multi_index.search(df.limit(0)).collect() == []
    assert multi_index.search(df.where("vec_id = 0")).collect() == []
    one = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (2, [-3.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in multi_index.search(one).orderBy("rank").collect()] == [(1, 3.0), (2, -3.0)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("a<p>b<p>c", "a\n\nb\n\nc"), ("<p>a  \n b</p>", "a b"), ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<div>a<div>b</div></div>c", "a\nb\nc"), ("a<b>b</b>c <i>d</i>", "abc d"), ("&lt;b&gt; &amp;&nbsp;&eacute;", "<b> & é"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<table><tr><th>k<th>value<tr><td>long key<td>v</table>", "k        | value\nlong key | v"),
        ("<table><tr><td colspan=2>head</td></tr><tr><td>a</td><td>b</td></tr></table>", "head\na | b"),
        ("<table><td>no row<td>x</table>t", "no row | x\n\nt"), ("<td>no table</td>", "no table"),
        ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        | b\n         |\nin | ner |"),
        ("<head><title>t</title><style>p{}</style></head><p>a", "a"), ("<title>t</title>a", "a"), ("<script>if (a < b) '</p>'</script>x", "x"),
        ("a<!-- <p>no --> b", "a b"), ("<div hidden>x<p>y</div>z", "z"), ('<p style="color:red; DISPLAY : none">x</p>y', "y"),
        ("<span style='visibility:hidden'>x</span>y", "y"), ("<noscript>x</noscript>y", "y"), ("<template><p>x</template>y", "y"),
        ("<pre> a\n   b\n</pre>c", " a\n   b\n\nc"), ("</div></p>a</b>", "a"), ("<h1>t</h1>x<hr>y", "t\n\nx\n\ny"), ("a <b", "a"), ("1 < 2 > 1", "1 < 2 > 1"),
        ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\nv\nl\nw"), ("<a title='x>y'>t</a>", "t"), ("<q>hi</q>", '"hi"'), ("<textarea>a\n b</textarea>", "a\n b"),
        ("<select><option>a<option>b</select>", "a\nb"), ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"), ("<input value=go><input type=hidden value=no>", "go"),
    ],
)
def test_visible_text(page, text):
    assert "\n".join(x.rstrip() for x in visible_text(page).split("\n")) == "\n".join(x.rstrip() for x in text.split("\n"))


def test_deep_and_broken_pages_end():
    assert visible_text("<div>" * 30_000 + "deep") == "deep"
    assert visible_text("<ul><li>" * 2000 + "deep").endswith("- deep")
    assert visible_text("<table><tr><td>" * 500 + "deep") == "deep"
    assert visible_text("<" * 5000) == "<" * 5000 and visible_text("<a b='" * 2000) == ""
    assert visible_text("word " * 100_000).count("word") == 100_000


@pytest.mark.parametrize(
    "page", ["<table><tr><td>x", "<table><tr><td>x<td>y", "<ul><li>x", "<table><tr><td rowspan=9>x<td colspan=3>", "<p>x<object><b></p>"]
)
def test_deep_pages_cost_their_length(page):
    began = time.perf_counter()
    text = visible_text(page * 20_000)
    assert time.perf_counter() - began < 20 and text.count("x") == (1 if "object" in page else 20_000)


@pytest.mark.parametrize(
    "page", ["<tr>" + "<td rowspan=60000>x" * 5000 + "<tr><td>x" * 5000, "<tr><td>" + "w" * 100_000 + "<td>x" + "<tr><td>y<td>x" * 5000]
)
def test_padding_stays_in_proportion(page):
    text = visible_text("<table>" + page)
    assert text.count("x") == page.count("x") and len(text) < 100 * len(page)


def random_tree(rng, depth: int, inline: bool = False) -> list:
    """Children of an element: texts and (tag, attributes, children)."""
    out: list = []
    for _ in range(rng.integers(0, 4)):
        kind = rng.choice(["text", "b", "br"] if inline or depth <= 0 else ["text", "b", "br", "div", "p", "ul", "ol", "table", "veil", "show"])
        if kind == "text":
            out.append(" ".join("abcdefgh"[: rng.integers(1, 8)] for _ in range(rng.integers(1, 4))))
        elif kind in ("ul", "ol"):
            out.append((kind, {}, [("li", {}, random_tree(rng, depth - 1)) for _ in range(rng.integers(1, 4))]))
        elif kind == "table":
            spans = [1, 1, 1, 2, 3]
            out.append(("table", {}, [
                ("tr", {}, [
                    ("td", {"colspan": int(rng.choice(spans)), "rowspan": int(rng.choice(spans))}, random_tree(rng, depth - 2))
                    for _ in range(rng.integers(0, 4))
                ]) for _ in range(rng.integers(1, 4))
            ]))
        elif kind in ("veil", "show"):
            out.append(("span", {"style": f"visibility:{'hidden' if kind == 'veil' else 'visible'}"}, random_tree(rng, 0, True)))
        else:
            out.append((kind, {}, [] if kind == "br" else random_tree(rng, depth - 1, inline or kind in ("b", "p"))))
    return out


def as_markup(tree: list) -> str:
    parts = []
    for node in tree:
        if isinstance(node, str):
            parts.append(node)
        else:
            name, attributes, children = node
            told = "".join(f" {k}='{v}'" for k, v in attributes.items())
            parts.append(f"<{name}{told}>" + ("" if name == "br" else as_markup(children) + f"</{name}>"))
    return "".join(parts)


def plain_events(tree: list, veiled: bool, nested: bool) -> list:
    """Texts, breaks, block borders (with or without margin) and finished lines, in order."""
    out: list = []
    for node in tree:
        if isinstance(node, str):
            out += [] if veiled else [("text", node)]
            continue
        name, attributes, children = node
        if name == "br":
            out += [] if veiled else [("br", None)]
        elif name in ("b", "span"):
            style = attributes.get("style", "")
            out += plain_events(children, veiled if not style else "hidden" in style, nested)
        elif name in ("div", "p"):
            out += [("border", name == "p"), *plain_events(children, veiled, nested), ("border", name == "p")]
        elif name in ("ul", "ol"):
            out.append(("border", not nested))
            for i, item in enumerate(children):
                lines = plain_lines(plain_events(item[2], veiled, True))
                mark = f"{i + 1}. " if name == "ol" else "- "
                marked = [(" " * len(mark) if j else mark) + x if x else x for j, x in enumerate(lines)]
                out += [("border", False), ("lines", marked), ("border", False)]
            out.append(("border", not nested))
        else:
            rows = [[(plain_lines(plain_events(c[2], veiled, False)), c[1]["colspan"], c[1]["rowspan"]) for c in row[2]] for row in children]
            out += [("border", True), ("lines", plain_table(rows)), ("border", True)]
    return out


def plain_lines(events: list) -> list[str]:
    lines: list[str] = []
    waiting, gap = "", False
    for kind, value in [*events, ("border", False)]:
        if kind == "text":
            waiting += value
            continue
        if kind == "br" and not waiting.strip():
            if lines and lines[-1] != "":
                lines.append("")
                gap = False
            continue
        fresh = [waiting.strip()] if waiting.strip() else []
        waiting = ""
        for block in (fresh, value if kind == "lines" else []):
            if block:
                lines += ([""] if gap and lines else []) + block
                gap = False
        gap |= kind == "border" and value
    return lines


def plain_table(rows: list) -> list[str]:
    taken: set = set()
    cells = []
    for r, row in enumerate(rows):
        c = 0
        for lines, across, down in row:
            while (r, c) in taken:
                c += 1
            taken |= {(y, x) for y in range(r, min(r + down, len(rows))) for x in range(c, c + across)}
            cells.append((r, c, across, lines))
            c += across
    real = sorted({c for _, c, _, _ in cells})
    if len(real) < 2:
        return [x for _, _, _, lines in cells for x in lines]
    start = dict.fromkeys(real, 0)
    for _ in real:
        for i, c in enumerate(real[1:], 1):
            reach = [start[a] + max(map(len, lines), default=0) for _, a, across, lines in cells if real[i - 1] < a + across <= c]
            start[c] = max([start[real[i - 1]], *reach]) + 3
    out = []
    for r in range(len(rows)):
        mine = [(start[c], lines) for y, c, _, lines in cells if y == r]
        for i in range(max((len(lines) for _, lines in mine), default=0)):
            line = ""
            for at, lines in mine:
                line = line.ljust(at - 3) + (" | " if at else "") + (lines[i] if i < len(lines) else "")
            out.append(line.rstrip())
    return out


def test_random_trees_like_the_plain_renderer():
    rng = np.random.default_rng(11)
    seen = 0
    for _ in range(1500):
        tree = random_tree(rng, 5)
        page = as_markup(tree)
        expected = "\n".join(plain_lines(plain_events(tree, False, False))).strip("\n")
        assert visible_text(page) == expected, page
        seen += "rowspan" in page and "|" in expected
    assert seen > 50


def test_extract_keeps_rows(spark):
    rows = [(1, "u", "<p>a<p>b", "x"), (1, "u", "<p>a<p>b", "x"), (None, None, None, None), (2, None, " ", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "a\n\nb", 3), (1, "u", "a\n\nb", 3), (None, None, "", 0), (2, None, "", 0)], key=str)
    assert extract(df.limit(0)).collect() == []
