"""Group-by, pivot and usage totals.

All aggregates combine before the shuffle. Aggregates whose state would hold a
whole group (mode, median) are computed from counts per (key, value) instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom._columns import as_list, cell_text, col, require, same
from tabloom.operators.ordering import order_columns
from tabloom.session import checkpointed


def _order_struct(df: DataFrame, order_by) -> Column:
    names = as_list(order_by)
    if not names:
        raise ValueError("first and last need order_by")
    require(df, names)
    return F.struct(*[col(n) for n in names])


def _simple(df: DataFrame, name: str, function: str, order_by) -> Column:
    c = col(name)
    if function == "count":
        return F.count(c)
    if function == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if function in ("min", "max"):
        return getattr(F, function)(c)
    if function in ("mean", "avg"):
        return F.avg(c)
    if function == "nunique":
        return F.count_distinct(c)
    if function == "std":
        return F.stddev_samp(c)
    if function == "var":
        return F.var_samp(c)
    if function == "first":
        return F.min_by(c, F.when(c.isNotNull(), _order_struct(df, order_by)))
    if function == "last":
        return F.max_by(c, F.when(c.isNotNull(), _order_struct(df, order_by)))
    raise ValueError(f"unknown aggregate: {function}")


def _mode(df: DataFrame, keys: list[str], name: str, output: str) -> DataFrame:
    """Most frequent value per key, the lowest on ties: counts first, then a minimum."""
    counts = (
        df.filter(col(name).isNotNull())
        .groupBy(*[col(k) for k in keys], col(name).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_value").alias("v")))["v"]
    return counts.groupBy(*[col(k) for k in keys]).agg(best.alias(output))


def _median(df: DataFrame, keys: list[str], name: str, output: str) -> DataFrame:
    """Exact median from counts per (key, value) sorted over all partitions.

    A running count inside each sorted partition plus the key's total in earlier
    partitions gives every value its rank range, so a hot key is spread over as
    many tasks as the sort needs.
    """
    counts = (
        df.filter(col(name).isNotNull())
        .groupBy(*[col(k) for k in keys], col(name).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = checkpointed(
        counts.orderBy(*[col(k) for k in keys], "_value").withColumn(
            "_part", F.shiftright(F.monotonically_increasing_id(), 33)
        )
    )
    here = [col(k) for k in keys]
    parts = placed.groupBy(*here, "_part").agg(F.sum("_n").alias("_size"))
    # At most one row per key and partition from here on.
    by_key = Window.partitionBy(*here)
    earlier = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *here,
        "_part",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(by_key).alias("_total"),
    )
    left, right = placed.alias("l"), parts.alias("r")
    joined = left.join(
        right,
        same([F.col(f"l.`{k}`") for k in keys], [F.col(f"r.`{k}`") for k in keys])
        & (F.col("l._part") == F.col("r._part")),
    ).select(*[F.col(f"l.`{k}`").alias(k) for k in keys], "_value", "_n", "l._part", "_before", "_total")
    running = Window.partitionBy(*here, "_part").orderBy("_value")
    upto = joined.withColumn("_upto", F.col("_before") + F.sum("_n").over(running))
    low, high = F.floor((F.col("_total") + 1) / 2), F.ceil((F.col("_total") + 1) / 2)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col("_value")))

    return upto.groupBy(*here).agg(((at(low) + at(high)) / 2).alias(output))


def group_by(df: DataFrame, group_by, aggregations, order_by=None, sort: bool = True) -> DataFrame:
    """Aggregate per key tuple; null keys form their own group.

    ``aggregations`` is a list of ``{column, function, output_column}``; the
    default output name is ``<column>_<function>``.
    """
    keys = as_list(group_by)
    steps = as_list(aggregations)
    require(df, keys + [s["column"] for s in steps])
    named = [
        (s["column"], s.get("function") or "count",
         s.get("output_column") or f"{s['column']}_{s.get('function') or 'count'}")
        for s in steps
    ]
    outputs = keys + [out for _, _, out in named]
    if len(set(outputs)) != len(outputs):
        raise ValueError("duplicate output column")
    plain = [(c, f, o) for c, f, o in named if f not in ("mode", "median")]
    wide = [(c, f, o) for c, f, o in named if f in ("mode", "median")]
    result = df.groupBy(*[col(k) for k in keys])
    if plain:
        result = result.agg(*[_simple(df, c, f, order_by).alias(o) for c, f, o in plain])
    else:
        result = result.agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    for name, function, output in wide:
        side = (_mode if function == "mode" else _median)(df, keys, name, output).alias("s")
        base = result.alias("b")
        result = base.join(
            side, same([F.col(f"b.`{k}`") for k in keys], [F.col(f"s.`{k}`") for k in keys]), "left"
        ).select("b.*", F.col(f"s.`{output}`"))
    result = result.select(*[col(c) for c in outputs])
    return result.orderBy(*order_columns(result, keys)) if sort and keys else result


# More values than this do not become columns; see bounded_values.
MOST_COLUMNS = 10_000


def bounded_values(values: DataFrame, most: int, instead: str) -> list:
    """The distinct values of a one-column table, in order. The driver gets ``most`` and one more at the most; a table
    with more of them is refused, and ``instead`` names the operator that takes any number."""
    found = [row[0] for row in values.distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values for columns; use {instead}")
    return sorted(found)


def pivot_values(df: DataFrame, pivot_column: str, most: int = MOST_COLUMNS) -> list:
    """The values that become columns; :func:`pivot_map` takes more than ``most``."""
    return bounded_values(df.select(col(pivot_column)).filter(col(pivot_column).isNotNull()), most, "pivot_map")


def _pivot_cells(df: DataFrame, index: str, pivot_column: str, value_column: str, agg_func: str, order_by) -> DataFrame:
    """(index, _pivot, _cell): one combining shuffle on both."""
    require(df, [index, pivot_column, value_column])
    functions = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}
    present = df.filter(col(index).isNotNull() & col(pivot_column).isNotNull())
    if agg_func in ("mean", "min", "max", "first"):
        present = present.filter(col(value_column).isNotNull())
    if agg_func == "first":
        if order_by is None:
            raise ValueError("first needs order_by")
        cell = F.min_by(col(value_column), _order_struct(df, order_by))
    elif agg_func == "sum":
        cell = F.coalesce(F.sum(col(value_column)), F.lit(0))
    elif agg_func in functions:
        cell = functions[agg_func](col(value_column))
    else:
        raise ValueError(f"unknown aggregate: {agg_func}")
    return present.groupBy(col(index), col(pivot_column).alias("_pivot")).agg(cell.alias("_cell"))


def pivot_map(
    df: DataFrame, index: str, pivot_column: str, value_column: str, agg_func: str = "sum", order_by=None
) -> DataFrame:
    """(index, cells): the cells of :func:`pivot` as a map from pivot value to cell, for any number of pivot values.

    Only cells that occur are held, so a row grows with the values of its own index and not with those of the table;
    the schema does not depend on the data, and nothing goes through the driver. Null indexes and pivot values drop out.
    """
    cells = _pivot_cells(df, index, pivot_column, value_column, agg_func, order_by)
    return cells.groupBy(col(index)).agg(F.map_from_entries(F.collect_list(F.struct("_pivot", "_cell"))).alias("cells"))


def pivot(
    df: DataFrame,
    index: str,
    pivot_column: str,
    value_column: str,
    agg_func: str = "sum",
    fill_value: str | float = "0",
    values: list | None = None,
    order_by=None,
) -> DataFrame:
    """Index rows by pivot-value columns; rows with a null index or pivot value drop out.

    For mean, min, max and first a pair without any value does not count; sum
    and count keep it. Missing cells get the fill value; a fill value that is
    not a number turns the cells into text.
    """
    cells = _pivot_cells(df, index, pivot_column, value_column, agg_func, order_by)
    if values is None:
        present = df.filter(col(index).isNotNull() & col(pivot_column).isNotNull())
        if agg_func in ("mean", "min", "max", "first"):
            present = present.filter(col(value_column).isNotNull())
        values = pivot_values(present, pivot_column)
    wide = cells.groupBy(col(index)).agg(
        *[
            F.max(F.when(F.col("_pivot") == F.lit(v), F.col("_cell"))).alias(str(v))
            for v in values
        ]
    )
    try:
        number = float(fill_value)
    except (TypeError, ValueError):
        number = None
    kinds = {f.name: f.dataType for f in wide.schema.fields}
    filled = []
    for name in (str(v) for v in values):
        if number is not None and isinstance(kinds[name], T.NumericType):
            filled.append(F.coalesce(col(name), F.lit(number).cast(kinds[name])).alias(name))
        else:
            text = F.when(col(name).isNull(), F.lit(str(fill_value))).otherwise(cell_text(wide, name))
            filled.append(text.alias(name))
    return wide.select(col(index), *filled).orderBy(col(index))


def usage_totals(calls: DataFrame, keys=("run_id", "row"), rollup: bool = False) -> DataFrame:
    """Token totals per run and row of a call log; ``rollup`` adds the run totals."""
    names = as_list(keys)
    grouped = calls.rollup(*names) if rollup else calls.groupBy(*names)
    tokens_in = F.coalesce(F.sum("input_tokens"), F.lit(0))
    tokens_out = F.coalesce(F.sum("output_tokens"), F.lit(0))
    return grouped.agg(
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        (tokens_in + tokens_out).alias("total_tokens"),
    )
