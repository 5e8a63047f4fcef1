"""One searchable text per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom._columns import as_list, cell_text, col


def build_corpus(df: DataFrame, doc_id: str, columns=None) -> DataFrame:
    """(doc_id, text): non-null cells joined by a blank; unknown columns are ignored."""
    wanted = as_list(columns) or list(df.columns)
    cells = [F.when(col(c).isNotNull(), cell_text(df, c)) for c in wanted if c in df.columns]
    if not cells:
        return df.select(col(doc_id).alias("doc_id"), F.lit("").alias("text")).limit(0)
    return df.select(col(doc_id).alias("doc_id"), F.concat_ws(" ", *cells).alias("text"))
