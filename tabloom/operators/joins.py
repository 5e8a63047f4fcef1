"""Equi join of two tables on one key per side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom._columns import col, require

_HOW = {"left": "left", "right": "right", "inner": "inner", "outer": "full"}


def merge(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", salt: int = 1
) -> DataFrame:
    """Join; null keys match null keys.

    A key of the same name becomes one column, other right columns that exist
    on the left get the suffix ``_right``. ``salt`` > 1 spreads every key over that
    many tasks by repeating the other side. An outer join repeats the right side for
    its left join, and adds the right rows whose key is not among the distinct left keys.
    """
    if not left_key or not right_key:
        raise ValueError("merge needs a key on both sides")
    if how not in _HOW:
        raise ValueError(f"unknown join type: {how}")
    require(left, [left_key])
    require(right, [right_key])
    if salt > 1 and how == "outer":
        known = left.select(col(left_key).alias("_known")).distinct()
        alone = right.join(known, col(right_key).eqNullSafe(F.col("_known")), "left_anti")
        # the empty left side gives the columns of a join, with no row that could match
        return merge(left, right, left_key, right_key, "left", salt).unionByName(
            merge(left.limit(0), alone, left_key, right_key, "right")
        )
    names = [f"_r{i}" for i in range(len(right.columns))]
    other = right.select(*[col(c).alias(n) for c, n in zip(right.columns, names, strict=True)])
    right_name = dict(zip(right.columns, names, strict=True))
    on = col(left_key).eqNullSafe(F.col(right_name[right_key]))
    if salt > 1:
        keep_left = how in ("inner", "left")
        # The salt depends on row content only, so a recomputed task repeats it.
        kept = [col(c) for c in left.columns] if keep_left else [F.col(n) for n in names]
        spread = F.pmod(F.xxhash64(*kept), F.lit(salt)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
        left = left.withColumn("_salt_l", spread if keep_left else copies)
        other = other.withColumn("_salt_r", copies if keep_left else spread)
        on = on & (F.col("_salt_l") == F.col("_salt_r"))
    joined = left.join(other, on, _HOW[how])
    result = []
    for name in left.columns:
        if name == "_salt_l":
            continue
        if name == left_key == right_key:
            result.append(F.coalesce(col(name), F.col(right_name[name])).alias(name))
        else:
            result.append(col(name))
    for name in right.columns:
        if name == left_key == right_key:
            continue
        label = f"{name}_right" if name in left.columns else name
        result.append(F.col(right_name[name]).alias(label))
    return joined.select(*result)
