"""Audit of how far the sources of a language diverge: smoothed term shares compared in whole numbers.

The tokenizer is a table: ``bytes.translate`` lowers A-Z and blanks everything else below 128 that is no letter in one
pass, ``bytes.split`` cuts, and a Counter per document gives frequencies; its keys are the document counts. A task sums
them per (language, source) and sends its sums on, so that a hot source is one row per term and task.

Every group gives a share to every kept term of its language, also to terms it does not hold, but only the terms that occur
are stored. A group's distance to another is the sum of what both shares differ by; terms that neither holds all differ by
the same amount, and terms that only one holds are read off the first group's histogram of shares:

    distance = A(g, h) + A(h, g) + B + (V - n_g - n_h) * |z_g - z_h|
    A(g, h)  = sum over the terms of g of |p_g - z_h|
    B        = sum over the terms of both of |p_g - p_h| - |p_g - z_h| - |z_g - p_h| + |z_g - z_h|

with z the share of a term that a group does not hold. So the work follows the terms that occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import stored, text_bytes, tidy
from tabloom.session import broadcast_if_small

LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Terms, and bytes of them, that a task holds before it sends them on; one document more at the most.
HELD_TERMS, HELD_BYTES = 200_000, 16 << 20

_LETTERS = bytes(range(0x41, 0x5B))
_BLANKS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = bytes.maketrans(_LETTERS + _BLANKS, _LETTERS.lower() + b" " * len(_BLANKS))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and documents that hold it."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        terms = size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                keys = list(n)
                for i in range(0, len(keys), 20_000):
                    part = keys[i : i + 20_000]
                    columns = [[lang] * len(part), [source] * len(part), part, [n[t] for t in part], [in_docs[t] for t in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            held.clear()

        for batch in batches:
            langs, sources = (batch.column(i).to_pylist() for i in (1, 2))
            for text, *group in zip(text_bytes(batch.column(0)), langs, sources):
                own = Counter(text.translate(LOWER).split())
                if not own:
                    continue
                n, in_docs = held.setdefault(tuple(group), (Counter(), Counter()))
                known = len(n)
                n.update(own)
                in_docs.update(own.keys())
                terms += len(n) - known
                size += sum(map(len, own)) if len(n) > known else 0
                if terms > HELD_TERMS or size > HELD_BYTES:
                    yield from out()
                    terms = size = 0
        yield from out()

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    counted = docs.select(text.alias("text"), *_group(docs)).mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _group(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _share(count: str, total: str, kept: str = "v") -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), exact beyond 64 bits."""
    above = f"CAST({SCALE} AS DECIMAL(11, 0)) * CAST({count} + {SMOOTH} AS DECIMAL(20, 0))"
    return F.expr(f"1 + ({above}) div CAST({total} + {SMOOTH} * {kept} AS DECIMAL(20, 0))")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every group of language and source in ``docs``.

    Part ``pair``: the distance to every other source of the language, all ranks, 0 without kept terms. Part ``term``: kept
    terms that the group holds and uses more than its language does, by how much, the first ``top_terms``. Ranks go by
    falling value, ties by the bytes of the item. Null text, lang and source count as empty; a group without terms has
    pairs only; repeated rows count one by one; texts are read whole. Other columns are ignored, and an empty table gives an
    empty result.
    """
    counts = stored(term_counts(docs))
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = stored(of_lang.drop("docs"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    held = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    # one row per group of language and source from here on
    groups = stored(
        docs.select(_group(docs)).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .na.fill(0, ["v", "lang_total", "total", "terms"])
        .withColumn("zero", F.when(F.col("v") > 0, _share("0", "total")))
    )
    small = broadcast_if_small(groups)
    shares = stored(
        held.join(small, ["lang", "source"])
        .select("lang", "source", "term", "zero", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
    )
    return _pairs(shares, groups).unionByName(_terms(shares, top_terms))


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def _terms(shares: DataFrame, top: int) -> DataFrame:
    more = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    return _ranked(more, top)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    def as_other(df: DataFrame, *names: str) -> DataFrame:
        return df.select("lang", F.col("source").alias("other"), *[F.col(c).alias(f"other_{c}") for c in names])

    apart = F.abs(F.col("zero") - F.col("other_zero"))
    others = broadcast_if_small(as_other(groups, "zero", "terms"))
    base = groups.join(others, "lang").where("source <> other").select(
        "lang", "source", "other", F.coalesce((F.col("v") - F.col("terms") - F.col("other_terms")) * apart, F.lit(0)).alias("value")
    )
    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    one_sided = (
        histogram.join(others, "lang").where("source <> other").groupBy("lang", "source", "other")
        .agg(F.sum(F.col("k") * F.abs(F.col("p") - F.col("other_zero"))).alias("value"))
    )
    overlap = (
        F.abs(F.col("p") - F.col("other_p")) - F.abs(F.col("p") - F.col("other_zero")) - F.abs(F.col("zero") - F.col("other_p")) + apart
    )
    right = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    common = (
        shares.select("lang", "term", "source", "p", "zero").join(right, ["lang", "term"]).where("source < other")
        .groupBy("lang", "source", "other").agg(F.sum(overlap).alias("value"))
    )
    # what is the same seen from either side, and A seen from the other
    swapped = [F.col("lang"), F.col("other").alias("source"), F.col("source").alias("other"), F.col("value")]
    parts = base.unionByName(one_sided).unionByName(one_sided.select(swapped)).unionByName(common).unionByName(common.select(swapped))
    sums = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    return _ranked(sums.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value"))


SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS MATERIALIZED (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING count(*) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, sum(n) AS n FROM c GROUP BY ALL),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n, kept.n AS ln FROM g JOIN kept USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + {SCALE}::HUGEINT * (n + {SMOOTH}) // (sum(n) OVER (PARTITION BY lang, source) + {SMOOTH} * v) AS p,
  1 + {SCALE}::HUGEINT * (ln + {SMOOTH}) // (total + {SMOOTH} * v) AS q FROM dense JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= {TOP_TERMS}
"""
