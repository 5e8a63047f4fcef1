"""Row-level operators: deduplication, sampling, unions, all-null rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom._columns import as_list, col, require, same
from tabloom.operators.ordering import order_columns


def deduplicate(
    df: DataFrame, columns=None, keep: str = "first", order_by=None
) -> dict[str, DataFrame]:
    """Split into ``unique`` and ``duplicates``; nulls compare equal.

    ``columns`` empty means all columns. ``order_by`` must identify a row and
    gives first/last their meaning. The kept row of each key is found by a
    combining aggregate and joined back on the row order, which is unique, so
    a key that holds a large share of the rows never lands in one task.
    """
    keys = as_list(columns) or list(df.columns)
    order = as_list(order_by)
    require(df, keys + order)
    if keep not in ("first", "last", "none"):
        raise ValueError(f"unknown keep: {keep}")
    if not order:
        return _deduplicate_copies(df, keys, keep)
    single = len(order) == 1
    position = col(order[0]) if single else F.struct(*[col(o) for o in order])
    pick = F.max(position) if keep == "last" else F.min(position)
    per_key = df.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        pick.alias("_pos"), F.count(F.lit(1)).alias("_n")
    )
    if keep == "none":
        per_key = per_key.filter(F.col("_n") == 1)
    if single:
        kept = per_key.select(F.col("_pos").alias("_o0"))
    else:
        kept = per_key.select(
            *[F.col("_pos").getField(o).alias(f"_o{i}") for i, o in enumerate(order)]
        )
    on = same([col(o) for o in order], [F.col(f"_o{i}") for i in range(len(order))])
    return {"unique": df.join(kept, on, "left_semi"), "duplicates": df.join(kept, on, "left_anti")}


def _deduplicate_copies(df: DataFrame, keys: list[str], keep: str) -> dict[str, DataFrame]:
    """Without an order: rows are ordered by their content and copies are counted."""
    names = list(df.columns)
    copies = df.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("_copies"))
    if set(keys) == set(names):
        left = F.col("_copies") - (0 if keep == "none" else 1)
        kept = copies.filter(F.col("_copies") == 1) if keep == "none" else copies
        rest = copies.filter(F.col("_copies") > 1) if keep == "none" else copies.filter(left > 0)
        again = rest.withColumn("_copy", F.explode(F.sequence(F.lit(1), left))).drop("_copy")
        return {"unique": kept.drop("_copies"), "duplicates": again.drop("_copies")}
    content = F.struct(*[col(c) for c in names])
    pick = F.max(content) if keep == "last" else F.min(content)
    per_key = copies.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        pick.alias("_row"), F.sum("_copies").alias("_n")
    )
    if keep == "none":
        per_key = per_key.filter(F.col("_n") == 1)
    kept = per_key.select("_row.*")
    # A kept row may be all null, so the match is read from its own mark.
    found = kept.select(
        *[col(c).alias(f"_o{i}") for i, c in enumerate(names)], F.lit(1).alias("_kept")
    )
    marked = copies.join(
        found, same([col(c) for c in names], [F.col(f"_o{i}") for i in range(len(names))]), "left"
    )
    left = F.col("_copies") - F.coalesce(F.col("_kept"), F.lit(0))
    rest = marked.filter(left > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), left)))
    return {"unique": kept, "duplicates": rest.select(*[col(c) for c in names])}


# Histogram cells per refinement step: four hexadecimal digits of the digest.
_DIGITS = 4
_FINE_ENOUGH = 100_000


def _digest(df: DataFrame, key, seed) -> Column:
    names = as_list(key) or list(df.columns)
    require(df, names)
    cells = [F.coalesce(col(n).cast("string"), F.lit("\u0000")) for n in names]
    return F.md5(F.concat_ws("\u0001", *cells, F.lit(str(seed))))


def sample(
    df: DataFrame,
    mode: str = "count",
    count: int = 100,
    percent: float = 10,
    seed: int = 0,
    key=None,
) -> DataFrame:
    """Exactly n rows, or an exact percentage, chosen by the digest of (key, seed).

    The n lowest digests are taken. Where the cut lies is read from a histogram
    of digest prefixes (65,536 cells whatever the table size); all cells below
    the cut are kept by a row-wise filter and only the cell at the cut is
    sorted. ``key`` should identify a row.
    """
    marked = df.withColumn("_digest", _digest(df, key, seed))
    names = [col(c) for c in df.columns]
    prefix, kept, wanted = "", [], None
    while True:
        inside = marked.filter(F.col("_digest").startswith(prefix)) if prefix else marked
        length = len(prefix) + _DIGITS
        cells = (
            inside.groupBy(F.substring("_digest", 1, length).alias("cell"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
        )
        if wanted is None:
            total = sum(c["n"] for c in cells)
            wanted = int(count) if mode == "count" else round(total * min(percent / 100.0, 1.0))
            if wanted >= total:
                return df
            if wanted <= 0:
                return df.limit(0)
        left, cut = wanted, None
        for cell in cells:
            if cell["n"] > left:
                cut = cell
                break
            left -= cell["n"]
        bound = cut["cell"]
        kept.append(inside.filter(F.substring("_digest", 1, length) < bound))
        if left == 0:
            break
        if cut["n"] <= _FINE_ENOUGH or length >= 32:
            edge = marked.filter(F.col("_digest").startswith(bound))
            kept.append(edge.orderBy("_digest").limit(left))
            break
        prefix, wanted = bound, left
    return reduce(DataFrame.unionAll, kept).select(*names)


def sample_fraction(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """Approximate percentage in one pass without counting."""
    return df.sample(fraction=min(percent / 100.0, 1.0), seed=seed)


def union_inputs(tables: list[DataFrame]) -> DataFrame:
    """Concatenate tables by column name; missing cells are null.

    A column whose type differs between inputs becomes text.
    """
    if not tables:
        raise ValueError("nothing to union")
    kinds: dict[str, set[str]] = {}
    for table in tables:
        for field in table.schema.fields:
            kinds.setdefault(field.name, set()).add(field.dataType.simpleString())
    clash = [name for name, seen in kinds.items() if len(seen) > 1]
    aligned = [
        t.withColumns({c: col(c).cast("string") for c in clash if c in t.columns}) for t in tables
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def drop_all_null(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


__all__ = [
    "deduplicate", "drop_all_null", "order_columns", "sample", "sample_fraction", "union_inputs",
]
