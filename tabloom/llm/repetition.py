"""Quality rules on repetition inside a text, from a suffix array of its words.

The words of some documents are numbered together and their suffixes sorted by prefix doubling, the document being part
of the first key, so that suffixes of one document stay together and never meet another's. The ranks of each round tell
how long neighbours agree: their common prefix is put together from the largest power of two downward. Intervals of the
common-prefix array whose occurrences follow different words are the maximal repeats.

Every occurrence of a maximal repeat is a span. Where an interval is not maximal, all its occurrences follow the same word
and the repeat one word longer covers them; so the union of all spans is that of the deepest interval of each suffix, and
no occurrence is listed twice however deeply intervals are nested ("a a a a ...").

The rules: a text fails if its words in three-word windows found twice are more than half, if it has few words, if repeats
of ``least`` words and more cover too large a part of it, or if one repeat is too long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import in_portions, text_bytes, tidy
from tabloom.llm.suffix_tree import intervals

#: Words a repeat has to have to count; part of the words, in percent, that repeats may cover; words of the longest. A line
#: or notice that stands twice in a short text is no fault yet.
LEAST, MOST_COVERED, MOST_LONG = 8, 45, 50
FEW_WORDS, WINDOW, MOST_WINDOWS = 50, 3, 50
#: Bytes of text whose suffixes are sorted together.
PORTION = 1 << 20

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_NO_CHARACTER = _SPACE + bytes(range(0x80, 0xC0))  # white space, and the later bytes of a character


def suffix_array(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of all documents, sorted by document and words, and the ranks of each round: equal ranks in round k are equal
    runs of 2**k words of one document. ``owner`` numbers the documents and rises."""
    n = len(words)
    key = owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rounds = [rank]
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))  # last word of each document
    end = np.repeat(last, np.diff(np.append(-1, last)))
    places = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of suffixes that share their rank
    step = 1
    while len(places):
        at = order[places]
        later = at + step
        inside = later <= end[at]
        second = np.where(inside, rank[np.where(inside, later, 0)], -1).astype(np.int64)
        first = rank[at].astype(np.int64)
        key = first * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        # the places of a rank are contiguous, so sorted suffixes fill the same places again
        order[places] = at
        new = np.ones(len(places), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, places, 0))
        rounds.append(rank)
        places = places[~(new & np.append(new[1:], True))]
        step *= 2
    return order, rounds


def common_prefixes(order: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """How many words each sorted suffix shares with the next one."""
    n = len(order)
    lcp = np.zeros(max(0, n - 1), np.int64)
    if n < 2:
        return lcp
    open_ = np.flatnonzero(rounds[0][order[:-1]] == rounds[0][order[1:]])
    a, b, shared = order[open_], order[open_ + 1], np.zeros(len(open_), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        x, y = a + shared, b + shared
        same = (x < n) & (y < n)
        same[same] = rounds[k][x[same]] == rounds[k][y[same]]
        shared[same] += 1 << k
    lcp[open_] = shared
    return lcp


def maximal(order: np.ndarray, lcp: np.ndarray, words: np.ndarray, owner: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, depth): the intervals of sorted suffixes that are maximal repeats of ``least`` words and more. Only the
    stretches of the array that share so much are scanned."""
    left = np.where(order > 0, words[order - 1], -1)
    starts = (order == 0) | (owner[order - 1] != owner[order])  # no word before the first of a document
    other = np.concatenate([[0], np.cumsum((left[1:] != left[:-1]) | starts[1:] | starts[:-1])])
    deep = np.flatnonzero(lcp >= least)
    found = []
    for part in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else []:
        base = int(part[0])
        for first, last, depth in intervals(lcp[part].tolist()):
            if depth >= least and other[base + last] > other[base + first]:
                found.append((base + first, base + last, depth))
    return found


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a span."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def repetition(texts: list[bytes], least: int) -> dict[str, np.ndarray | list]:
    """Per text: n_words, n_repeat_words, n_covered, longest, n_repeats and the spans (first word, words) covered."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    cut = [t.split() for t in texts]
    sizes = np.array([len(w) for w in cut], np.int64)
    words = np.fromiter((number[w] for own in cut for w in own), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    n, m = len(words), len(texts)
    order, rounds = suffix_array(words, owner)
    lcp = common_prefixes(order, rounds)
    del rounds
    deepest = np.zeros(n, np.int64)
    if n > 1:
        deepest[order] = np.maximum(np.append(lcp, 0), np.insert(lcp, 0, 0))
    window = np.flatnonzero(deepest >= WINDOW)
    in_window = _covered(window, np.full(len(window), WINDOW), n)
    at = np.flatnonzero(deepest >= least)
    inside = _covered(at, deepest[at], n)
    longest, n_repeats = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for first, _, depth in maximal(order, lcp, words, owner, least):
        doc = owner[order[first]]
        longest[doc] = max(longest[doc], depth)
        n_repeats[doc] += 1
    firsts = np.cumsum(sizes) - sizes
    spans: list[list] = [[] for _ in texts]
    change = np.flatnonzero(inside & ~(np.insert(inside[:-1], 0, False) & (np.insert(owner[:-1], 0, -1) == owner))) if n else []
    stop = np.flatnonzero(inside & ~(np.append(inside[1:], False) & (np.append(owner[1:], -1) == owner))) if n else []
    for a, b in zip(change, stop):
        spans[owner[a]].append({"start": int(a - firsts[owner[a]]), "words": int(b - a + 1)})
    return {
        "n_words": sizes, "n_repeat_words": np.bincount(owner[in_window], minlength=m), "n_covered": np.bincount(owner[inside], minlength=m),
        "longest": longest, "n_repeats": n_repeats, "spans": spans,
    }


def _symbols_and_lines(text: bytes) -> tuple[int, int, int]:
    """Code points in words, symbols, and lines with a word that equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(text.translate(None, _NO_CHARACTER)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines))


def rules(
    docs: DataFrame, least: int = LEAST, most_covered: int = MOST_COVERED, most_long: int = MOST_LONG,
    few_words: int = FEW_WORDS, most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_covered,
    longest, n_repeats, spans, kept.

    Words are what ASCII white space parts; texts are taken whole. A null, empty or blank text has no words and fails. Rows
    are judged one by one, so a null or repeated id, equal texts and the order of rows change nothing. Other columns are
    ignored; an empty table gives an empty result. A task sorts the suffixes of about ``PORTION`` bytes of texts at a time, or
    of one longer text, which takes some 4 bytes a word for every doubling of its longest repeat.
    """
    fields = {
        "doc_id": "long", "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
        "n_covered": "long", "longest": "long", "n_repeats": "long", "spans": "array<struct<start: long, words: long>>",
    }
    span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
    schema = pa.schema([(c, span if c == "spans" else pa.int64()) for c in fields])

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_portions(batches, PORTION):
            texts = text_bytes(part.column(1))
            own = repetition(texts, least)
            own["doc_id"] = part.column(0)
            own["word_chars"], own["n_symbols"], own["n_dup_lines"] = map(list, zip(*map(_symbols_and_lines, texts), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) for f in schema], schema=schema)

    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        measure, ", ".join(f"{c} {t}" for c, t in fields.items())
    )
    n = F.col("n_words")
    failed = (n < few_words) | (100 * F.col("n_repeat_words") > most_windows * n)
    passed = (100 * F.col("n_covered") <= most_covered * n) & (F.col("longest") <= most_long)
    return measured.select(
        *[c for c in fields if c not in ("n_covered", "longest", "n_repeats", "spans")], failed.alias("base_failed"),
        "n_covered", "longest", "n_repeats", "spans", (~failed & passed).alias("kept"),
    )


def _sql() -> str:
    """Words in repeats of LEAST words and more are those in windows of LEAST words found twice; a repeat is longer than
    MOST_LONG where a window of one word more is found twice."""

    def inside(width: int) -> str:
        return rf"""
w{width} AS (SELECT r, i, hash(list_slice(w, i, i + {width - 1})) AS k FROM (SELECT r, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d)),
c{width} AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {width})) AS j FROM
  (SELECT r, i FROM w{width} QUALIFY count(*) OVER (PARTITION BY r, k) > 1)) GROUP BY r)"""

    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
{inside(WINDOW)},
{inside(LEAST)},
{inside(MOST_LONG + 1)},
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(c{WINDOW}.n, 0) AS n_repeat_words, coalesce(c{LEAST}.n, 0) AS n_covered, coalesce(c{MOST_LONG + 1}.n, 0) AS long_words
  FROM d JOIN lines USING (r) LEFT JOIN c{WINDOW} ON c{WINDOW}.r = d.r LEFT JOIN c{LEAST} ON c{LEAST}.r = d.r LEFT JOIN c{MOST_LONG + 1} ON c{MOST_LONG + 1}.r = d.r),
f AS (SELECT *, n_words < {FEW_WORDS} OR 100 * n_repeat_words > {MOST_WINDOWS} * n_words AS base_failed FROM m)
SELECT * EXCLUDE long_words, NOT base_failed AND 100 * n_covered <= {MOST_COVERED} * n_words AND long_words = 0 AS kept FROM f
"""


SQL = _sql()
