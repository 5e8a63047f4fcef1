"""Reference text for a processing phase from tagged knowledge entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = "═══ REFERENCE KNOWLEDGE BASE ═══"


def knowledge_sections(entries: DataFrame, phase: str) -> DataFrame:
    """(id, section): entries of the phase rendered as titled sections."""
    return entries.filter(F.array_contains("phases", phase)).select(
        "id",
        F.concat(
            F.lit("### "), F.coalesce("title", F.lit("Untitled")), F.lit("\n"),
            F.coalesce("content", F.lit("")), F.lit("\n"),
        ).alias("section"),
    )


def _one_text(entries: DataFrame, phase: str, order_by: str) -> DataFrame:
    """One row with the whole reference text of a phase, its sections in order."""
    sections = knowledge_sections(entries, phase).select(F.col("id").alias(order_by), "section")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_by), F.col("section"))))
    listed = F.transform(ordered, lambda e: e["section"])
    text = F.array_join(F.concat(F.array(F.lit(HEADER), F.lit("")), listed), "\n")
    return sections.agg(F.when(F.count(F.lit(1)) > 0, text).otherwise("").alias("_knowledge"))


def knowledge_text(entries: DataFrame, phase: str, order_by: str = "id") -> str:
    """The whole reference text of a phase, to read."""
    return _one_text(entries, phase, order_by).first()["_knowledge"]


def add_knowledge(df: DataFrame, entries: DataFrame, phase: str, output: str = "knowledge") -> DataFrame:
    """The reference text of a phase on every row; it is one row and never passes through the driver."""
    return df.crossJoin(_one_text(entries, phase, "id")).withColumnRenamed("_knowledge", output)
