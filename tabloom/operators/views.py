"""Looking at tables: previews, column filters, full-text search, row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabloom._columns import cell_text, col, require
from tabloom.operators.ordering import order_columns


def preview(df: DataFrame, order_by=None, rows: int = 100, width: int = 200) -> DataFrame:
    """First rows with every cell as text of limited width."""
    ordered = df.orderBy(*order_columns(df, order_by)) if order_by else df
    return ordered.limit(rows).select(
        *[F.substring(cell_text(df, c), 1, width).alias(c) for c in df.columns]
    )


def profile(df: DataFrame, sample_rows: int = 5) -> dict:
    """Columns, row count and a few rows, as shown when a table is loaded."""
    return {
        "columns": list(df.columns),
        "row_count": df.count(),
        "sample": [r.asDict() for r in df.limit(sample_rows).collect()],
    }


def filter_columns(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Keep rows in which every named column contains its text, ignoring case."""
    require(df, texts)
    for name, text in texts.items():
        if text:
            df = df.filter(F.lower(cell_text(df, name)).contains(text.lower()))
    return df


def search_all(df: DataFrame, text: str) -> DataFrame:
    """Keep rows in which some column contains the text, ignoring case."""
    if not text:
        return df
    hit = F.lit(False)
    for name in df.columns:
        hit = hit | F.lower(cell_text(df, name)).contains(text.lower())
    return df.filter(hit)


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Count rows while they pass; read the count after the next action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def row_message(rows_out: int, rows_in: int) -> str:
    """Message of a finished operator: rows out, or rows in for sinks."""
    return f"Exported {rows_in} rows" if rows_out == 0 and rows_in else f"{rows_out} rows"


def select_columns(df: DataFrame, columns) -> DataFrame:
    return df.select(*[col(c) for c in columns])
