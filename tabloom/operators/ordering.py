"""Row numbers and limits over a stated order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom._columns import as_list, col, require
from tabloom.session import checkpointed

# Above this many rows a limit is taken by row number instead of a top-n heap.
HEAP_LIMIT = 100_000


def order_columns(df: DataFrame, order_by) -> list[Column]:
    """Order given as names; a leading ``-`` means descending. Nulls come last."""
    result = []
    for item in as_list(order_by):
        if isinstance(item, Column):
            result.append(item)
            continue
        name, down = (item[1:], True) if item.startswith("-") and item not in df.columns else (item, False)
        require(df, [name])
        result.append(col(name).desc_nulls_last() if down else col(name).asc_nulls_last())
    if not result:
        raise ValueError("order_by is required: row order carries meaning here")
    return result


def with_row_index(df: DataFrame, order_by, name: str = "_index") -> DataFrame:
    """Number the rows 0, 1, 2, ... in a total order.

    The rows are range-sorted and written once (reliable checkpoint); their
    number is the position inside the partition plus the size of the earlier
    partitions, so no task ever sees more than its own partition.
    """
    ordered = df.orderBy(*order_columns(df, order_by)).withColumn(
        "_slot", F.monotonically_increasing_id()
    )
    ordered = checkpointed(ordered)
    partition = F.shiftright("_slot", 33)
    position = F.col("_slot").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(partition.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a window over them is small whatever the table size.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        ordered.withColumn("_part", partition)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + position)
        .drop("_part", "_start", "_slot")
    )


def head(df: DataFrame, n: int, order_by) -> DataFrame:
    """First n rows in order."""
    if n <= HEAP_LIMIT:
        return df.orderBy(*order_columns(df, order_by)).limit(n)
    return with_row_index(df, order_by, "_index").filter(F.col("_index") < n).drop("_index")


def sort(df: DataFrame, column: str, direction: str = "asc") -> DataFrame:
    require(df, [column])
    key = col(column).desc_nulls_last() if direction == "desc" else col(column).asc_nulls_last()
    return df.orderBy(key)
