"""Exact work on all pairs of two tables, in blocks of bounded size.

Both tables are cut into blocks by a hash of their row key; every pair of
blocks is one group, and the function reports only what survives inside the
pair (a best match, a local top-k). Pairs themselves are never materialised.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom._columns import col
from tabloom.session import work_partitions


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    left_key: str,
    right_key: str,
    left_rows: int,
    right_rows: int,
) -> DataFrame:
    left_blocks = max(1, math.ceil(left.count() / left_rows))
    right_blocks = max(1, math.ceil(right.count() / right_rows))

    def own(key: str, blocks: int):
        return F.pmod(F.xxhash64(col(key)), F.lit(blocks)).cast("int")

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    # Both sides may come from one table; new column identities keep them apart.
    right = right.toDF(*[f"_r_{c}" for c in right.columns])
    names = [c[3:] for c in right.columns]
    right_key = f"_r_{right_key}"
    one = left.withColumn("_lb", own(left_key, left_blocks)).withColumn("_rb", every(right_blocks))
    two = right.withColumn("_rb", own(right_key, right_blocks)).withColumn("_lb", every(left_blocks))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return score(a.drop(columns=["_lb", "_rb"]), b.drop(columns=["_lb", "_rb"]).set_axis(names, axis=1))

    # A fixed partition count: merging by input size would starve this step of tasks.
    tasks = work_partitions(left.sparkSession)
    one, two = (side.repartition(tasks, "_lb", "_rb") for side in (one, two))
    return one.groupBy("_lb", "_rb").cogroup(two.groupBy("_lb", "_rb")).applyInPandas(run, schema)
