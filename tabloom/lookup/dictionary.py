"""Look a column up in a dictionary: exact, contained key, or fuzzy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom._columns import cell_text, require
from tabloom.lookup import fuzzy, substrings
from tabloom.lookup.tables import as_dictionary, fold_case, ordered_pairs
from tabloom.session import broadcast_if_small


def lookup(
    df: DataFrame,
    dictionary,
    source_column: str,
    output_column: str,
    match_mode: str = "exact",
    case_sensitive: bool = False,
    no_match_value: str = "",
) -> DataFrame:
    """Add the dictionary value of the source cell; an empty value counts as no match.

    ``dictionary`` is a registered name, a mapping or a (key, value[, ord])
    DataFrame. Only a dictionary below a measured size is shipped to the tasks;
    a larger one is joined.
    """
    require(df, [source_column])
    table = as_dictionary(df.sparkSession, dictionary)
    table = table if case_sensitive else fold_case(table)
    text = cell_text(df, source_column)
    text = text if case_sensitive else F.lower(text)
    if match_mode == "exact":
        if case_sensitive:
            table = table.groupBy("key").agg(F.max_by("value", "ord").alias("value"))
        side = table.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
        found = df.withColumn("_text", text).join(
            broadcast_if_small(side), F.col("_text") == F.col("_key"), "left"
        )
    elif match_mode in ("contains", "fuzzy"):
        pairs = ordered_pairs(table)
        if pairs is not None:
            pick = substrings.first_hit if match_mode == "contains" else fuzzy.best_key
            found = df.withColumn("_value", pick(text, pairs))
        else:
            found = _joined(df.withColumn("_text", text), table, match_mode)
    else:
        raise ValueError(f"unknown match mode: {match_mode}")
    value = F.coalesce(F.nullif(F.col("_value"), F.lit("")), F.lit(no_match_value))
    return found.withColumn(output_column, value).drop("_text", "_key", "_value")


def _joined(df: DataFrame, table: DataFrame, match_mode: str) -> DataFrame:
    """Match each distinct text once against a large dictionary and join back."""
    texts = df.select(F.col("_text").alias("text")).distinct()
    if match_mode == "fuzzy":
        best = fuzzy.best_keys(texts, table).select(
            F.col("text").alias("_key"), F.col("value").alias("_value")
        )
        return df.join(best, F.col("_text") == F.col("_key"), "left")
    hits = substrings.hits(texts, table).groupBy("digest").agg(
        F.min(F.struct("ord", "key", "value")).alias("_hit")
    )
    # An empty key is contained in every text and competes by its order.
    empty = table.filter("key = ''").agg(F.min(F.struct("ord", "key", "value")).alias("e")).first()["e"]
    hit = F.col("_hit")
    if empty is not None:
        kind = table.schema["ord"].dataType
        always = F.struct(
            F.lit(empty["ord"]).cast(kind).alias("ord"), F.lit("").alias("key"), F.lit(empty["value"]).alias("value")
        )
        hit = F.least(hit, always)
    joined = df.join(hits, F.md5("_text") == F.col("digest"), "left")
    return joined.withColumn("_value", hit["value"]).drop("digest", "_hit")
