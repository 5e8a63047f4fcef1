"""Prompts and request batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom._columns import cell_text, col
from tabloom.operators.columns import template
from tabloom.operators.ordering import with_row_index


def render_prompts(df: DataFrame, prompt_template: str, output: str = "prompt") -> DataFrame:
    return df.withColumn(output, template(df, prompt_template))


def row_context(df: DataFrame, columns=None, fields: int = 15, width: int = 200) -> Column:
    """``name: value`` lines of the first non-empty cells of a row."""
    lines = []
    for name in columns or df.columns:
        text = cell_text(df, name)
        line = F.concat(F.lit(f"{name}: "), F.substring(text, 1, width))
        lines.append(F.when(text != "", line))
    return F.array_join(F.slice(F.array_compact(F.array(*lines)), 1, fields), "\n")


def pack_requests(
    df: DataFrame,
    row_id: str,
    prompt: str = "prompt",
    batch_size: int = 5,
    max_tokens: int = 300,
    order_by=None,
    title: str = "Item",
) -> tuple[DataFrame, DataFrame]:
    """Group consecutive rows into requests of ``batch_size`` numbered blocks.

    Returns the requests (batch_id, prompt, size, max_tokens) and the members
    (batch_id, position, row_id). A group never exceeds the batch size.
    """
    size = max(1, int(batch_size))
    indexed = with_row_index(
        df.select(*{row_id: col(row_id), prompt: col(prompt)}.values(),
                  *[col(c) for c in _extra(order_by, row_id, prompt)]),
        order_by or row_id,
    )
    members = indexed.select(
        F.floor(F.col("_index") / size).alias("batch_id"),
        (F.col("_index") % size).cast("int").alias("position"),
        col(row_id).alias("row_id"),
        col(prompt).alias("prompt"),
    )
    block = F.concat(F.lit(f"=== {title} "), F.col("position").cast("string"), F.lit(" ===\n"), "prompt")
    packed = members.groupBy("batch_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", block.alias("block")))),
                lambda b: b["block"],
            ),
            "\n\n",
        ).alias("prompt"),
        F.count(F.lit(1)).cast("int").alias("size"),
    )
    requests = packed.withColumn("max_tokens", F.col("size") * F.lit(int(max_tokens)))
    return requests, members.select("batch_id", "position", "row_id")


def _extra(order_by, *taken: str) -> list[str]:
    names = [order_by] if isinstance(order_by, str) else list(order_by or [])
    return [n for n in dict.fromkeys(x.lstrip("-") for x in names) if n not in taken]
