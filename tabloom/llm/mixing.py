"""Mix sources to target weights by Pareto order sampling, in DataFrame operations only.

A source with target T and S words gets ``whole = floor(T / S)`` certain copies of every
document. The rest of the target, R words, is a sample of fixed size in words with unequal probabilities: a document of s
words is included with probability ``p = min(1, c * s)``, in proportion to what it adds, and c is such that the expected
words, the sum of p * s, are R. Documents that reach 1 are certain; c is found for the others from the counts per size.
With a uniform number ``u`` from the document's id, documents are ranked by ``(u / (1 - u)) / (p / (1 - p))``, random odds
over inclusion odds, and taken in that order while they fit. A document too large for what is left is passed over and
the draw goes on behind it, a few times; what then is left open is topped up by the largest documents that fit.

The order is cut into buckets. Sums per (source, bucket) are taken first, and only the one
bucket of a source in which its sample ends is ordered row by row, so that a source with a
third of all rows is never one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom._columns import col
from tabloom.llm.common import stored, word_count
from tabloom.session import broadcast_if_small

BUCKETS = 4096
DRAWS = 3
TOP_UPS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source: number in code-point order (null last), words, target.

    ``sizes`` has ``source`` and ``size``. The sum of all sizes is shared by weight; a source
    gets ``most`` times its words at the most, and what it leaves goes to the others by weight.
    With the sources ordered by words per weight, those that reach their limit come first, so
    one running sum finds them all. The table has a row per source, not per document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    numbered = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("sid", (F.row_number().over(by_name) - 1).cast("int"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1))
    )
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = (
        numbered.withColumn("left", left).withColumn("weight_left", weight_left)
        .withColumn("full", most * F.col("source_size") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    )
    open_left = F.max(F.when(~F.col("full"), F.col("left"))).over(everything)
    open_weight = F.max(F.when(~F.col("full"), F.col("weight_left"))).over(everything)
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(
        open_left * F.col("weight") / open_weight
    )
    return ranked.withColumn("target", target).select("sid", "source", "source_size", "target")


def _uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def inclusion(sized: DataFrame) -> DataFrame:
    """(sid, open_size, c) from rows (sid, size, rest): documents above ``open_size`` words are certain, others are included
    with probability c * size. Sources that have nothing left to draw are not in it.

    A source's distinct sizes are at most the root of twice its words, so its counts per size are a small table.
    """
    counts = sized.where("size > 0 AND rest > 0").groupBy("sid", "rest", "size").agg(F.count(F.lit(1)).alias("n"))
    falling = Window.partitionBy("sid").orderBy(F.desc("size"))
    above = F.coalesce(F.sum(F.col("n") * F.col("size")).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum(F.expr("CAST(n * size AS DECIMAL(20, 0)) * CAST(size AS DECIMAL(12, 0))").cast("decimal(38, 0)")).over(
        falling.rowsBetween(0, Window.unboundedFollowing)
    )
    steps = counts.withColumn("left", F.col("rest") - above.cast("double")).withColumn("squares", squares.cast("double"))
    free = steps.where(F.col("size") * F.col("left") < F.col("squares"))
    best = free.groupBy("sid").agg(F.max(F.struct("size", (F.col("left") / F.col("squares")).alias("c"))).alias("b"))
    return best.select("sid", F.col("b.size").alias("open_size"), F.col("b.c").alias("c"))


def _gaps(drawn: DataFrame) -> DataFrame:
    """What is left of each source's sample."""
    gap = F.max("rest") - F.sum(F.col("size") * F.col("extra"))
    return drawn.where("q IS NOT NULL").groupBy("sid").agg(gap.alias("gap"))


def _draw(drawn: DataFrame) -> DataFrame:
    """Take documents that fit into the gap of their source in the order of their rank, until one does not."""
    known = drawn.join(broadcast_if_small(_gaps(drawn)), "sid", "left")
    fits = (F.col("extra") == 0) & F.col("q").isNotNull() & (F.col("size") <= F.col("gap"))
    known = known.withColumn("fits", F.coalesce(fits, F.lit(False)))
    free = known.where("fits")
    order = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = free.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    placed = free.join(sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))), ["sid", "bucket"])
    inside = F.col("before") + F.col("words") <= F.col("gap")
    within = Window.partitionBy("sid", "bucket").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(~inside & (F.col("before") <= F.col("gap")))
    edge = edge.withColumn("extra", (F.col("before") + F.sum("size").over(within) <= F.col("gap")).cast("int"))
    others = placed.where(inside | (F.col("before") > F.col("gap"))).withColumn("extra", inside.cast("int"))
    parts = [edge, others, known.where("NOT fits")]
    return parts[0].select(drawn.columns).unionByName(parts[1].select(drawn.columns)).unionByName(parts[2].select(drawn.columns))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Copies of each document in the mix: id, size, source_size, target, taken, copies.

    A null text has size 0; a null source is a source of its own, the last. Documents without
    words and sources without words take nothing. Rows that share an id share their place in
    the order and count one by one. An empty table gives an empty result. The text is read once;
    all further steps run on (id, source, size). The names in ``docs`` do not matter beyond the three.
    """
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
        )
    )
    targets = stored(source_targets(sized, weights, most))
    small = broadcast_if_small(targets)
    joined = sized.join(small, sized.source.eqNullSafe(small.source)).drop("source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shared = joined.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    p = F.when(F.col("size") > F.col("open_size"), 1.0).otherwise(F.col("c") * F.col("size"))
    u = _uniform(F.col("doc_id"))
    odds = F.when(p < 1, u / (1 - u) * (1 - p) / p).otherwise(0.0)
    ranked = stored(
        shared.join(broadcast_if_small(stored(inclusion(shared))), "sid", "left")
        .withColumn("q", F.when((F.col("size") > 0) & F.col("c").isNotNull(), odds))
        .withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS))
        .drop("open_size", "c")
    )
    drawn = ranked.withColumn("extra", F.lit(0))
    for _ in range(DRAWS):
        drawn = stored(_draw(drawn))
    copies = F.col("whole") + F.col("extra")
    for _ in range(TOP_UPS):
        gaps = broadcast_if_small(_gaps(drawn))
        free = drawn.where((F.col("extra") == 0) & F.col("q").isNotNull())
        best = (
            free.join(gaps, "sid").where(F.col("size") <= F.col("gap")).groupBy("sid")
            .agg(F.min(F.struct(-F.col("size"), "q", "doc_id")).alias("b"))
            .select("sid", F.col("b.doc_id").alias("doc_id"), F.lit(1).alias("more"))
        )
        best = stored(best)
        drawn = drawn.join(broadcast_if_small(best), ["sid", "doc_id"], "left")
        drawn = drawn.withColumn("extra", F.greatest("extra", F.coalesce("more", F.lit(0)))).drop("more")
    return drawn.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"),
        copies.cast("int").alias("copies"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it; columns as in ``docs``.

    Rows of one id take the same number of copies, the largest found for the id.
    """
    taken = mix(docs, weights, most).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    whole = docs.select(F.struct(*map(col, docs.columns)).alias("own"), F.col("doc_id").alias("own_id"))
    joined = whole.join(taken, F.col("own_id").eqNullSafe(F.col("doc_id")))
    copied = joined.select("own", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return copied.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])


#: The same mix in SQL over ``documents``; the sample is drawn with plain windows.
SQL_HEAD = r"""
WITH sized AS MATERIALIZED (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s1),
s3 AS (SELECT *, sid % 3 + 1 AS weight FROM s2),
s4 AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM s3),
s5 AS (SELECT *, 3 * source_size * w <= l * weight AS isfull FROM s4),
s6 AS (SELECT *, max(l) FILTER (NOT isfull) OVER () AS ol, max(w) FILTER (NOT isfull) OVER () AS ow FROM s5),
targets AS (SELECT sid, source, source_size, CASE WHEN isfull THEN (3 * source_size)::DOUBLE ELSE (ol::BIGINT * weight)::DOUBLE / ow::BIGINT END AS target FROM s6),
r1 AS (SELECT sid, doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
  (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
r2 AS MATERIALIZED (SELECT *, floor(ratio) AS whole, target - floor(ratio) * source_size AS rest FROM r1),
n1 AS (SELECT sid, rest, size, count(*) AS n FROM r2 WHERE size > 0 AND rest > 0 GROUP BY ALL),
n2 AS (SELECT sid, size, rest - coalesce(sum(n * size) OVER (PARTITION BY sid ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS open,
  sum(n::HUGEINT * size * size) OVER (PARTITION BY sid ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS squares FROM n1),
n3 AS (SELECT sid, size AS open_size, open / squares AS c FROM n2 WHERE size * open < squares QUALIFY row_number() OVER (PARTITION BY sid ORDER BY size DESC) = 1),
r3 AS (SELECT * EXCLUDE (open_size, c), CASE WHEN size = 0 OR c IS NULL THEN NULL WHEN size > open_size OR c * size >= 1 THEN 0 ELSE u / (1 - u) * (1 - c * size) / (c * size) END AS q
  FROM r2 LEFT JOIN n3 USING (sid)),
x0 AS (SELECT *, 0 AS extra FROM r3)
"""


def _sql() -> str:
    steps = [SQL_HEAD.rstrip()]
    for i in range(DRAWS + TOP_UPS):
        steps.append(f"g{i} AS (SELECT sid, max(rest) - sum(size * extra) AS gap FROM x{i} WHERE q IS NOT NULL GROUP BY sid)")
        fits = "extra = 0 AND q IS NOT NULL AND size <= gap"
        if i < DRAWS:
            take = f"""{fits} AND sum(CASE WHEN {fits} THEN size ELSE 0 END) OVER
  (PARTITION BY sid ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap"""
            steps.append(f"""x{i + 1} AS MATERIALIZED (SELECT * EXCLUDE gap REPLACE (CASE WHEN {take} THEN 1 ELSE extra END AS extra)
  FROM x{i} LEFT JOIN g{i} USING (sid))""")
            continue
        steps.append(
            f"""b{i} AS (SELECT sid, doc_id FROM x{i} JOIN g{i} USING (sid) WHERE {fits}
  QUALIFY row_number() OVER (PARTITION BY sid ORDER BY size DESC, q, doc_id) = 1),
x{i + 1} AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN b.doc_id IS NULL THEN extra ELSE 1 END AS extra) FROM x{i} x LEFT JOIN b{i} b ON x.sid = b.sid AND x.doc_id = b.doc_id)"""
        )
    return ",\n".join(steps) + (
        f"\nSELECT doc_id, size, source_size, target, ((whole + extra) * size)::BIGINT AS taken FROM x{DRAWS + TOP_UPS}"
    )


SQL = _sql()
