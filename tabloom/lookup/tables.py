"""Registry of code tables. A table is a DataFrame (key, value, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom._columns import require
from tabloom.lookup import fixed_values as fixed
from tabloom.session import small_rows

_BUILT_IN: dict[str, dict[str, str]] = {
    "bl_area_codes": fixed.AREA_CODES,
    "bl_subject_codes": fixed.SUBJECT_CODES,
    "theme_to_bl_subject": fixed.THEME_SUBJECTS,
}
_REGISTERED: dict[str, DataFrame | dict[str, str]] = {}


def register_dictionary(name: str, table: DataFrame | dict[str, str]) -> None:
    """Make a table available by name; ``place_to_bl_area`` is supplied this way."""
    _REGISTERED[name] = table


def dictionary_names() -> list[str]:
    return sorted({*_BUILT_IN, *_REGISTERED, "place_to_bl_area"})


def places_from_areas(spark: SparkSession, areas: dict[str, str] | None = None) -> DataFrame:
    """Place table by rule: every area description in lower case names its code.

    Used for ``place_to_bl_area`` until a fuller table is registered.
    """
    pairs = {text.lower(): code for code, text in (areas or fixed.AREA_CODES).items()}
    return from_pairs(spark, pairs)


def from_pairs(spark: SparkSession, pairs: dict[str, str]) -> DataFrame:
    rows = [(k, v, i) for i, (k, v) in enumerate(pairs.items())]
    return spark.createDataFrame(rows, "key string, value string, ord bigint")


def as_dictionary(spark: SparkSession, table: str | dict[str, str] | DataFrame) -> DataFrame:
    """A name, a mapping or a DataFrame as (key, value, ord).

    A DataFrame needs ``key`` and ``value``; without ``ord`` keys are ordered by
    their text.
    """
    if isinstance(table, str):
        if table in _REGISTERED:
            return as_dictionary(spark, _REGISTERED[table])
        if table in _BUILT_IN:
            return from_pairs(spark, _BUILT_IN[table])
        if table == "place_to_bl_area":
            return places_from_areas(spark)
        raise ValueError(f"unknown dictionary: {table}")
    if isinstance(table, dict):
        return from_pairs(spark, table)
    require(table, ["key", "value"])
    ord_column = F.col("ord") if "ord" in table.columns else F.col("key").alias("ord")
    return table.select(
        F.col("key").cast("string"), F.col("value").cast("string"), ord_column
    ).filter("key is not null")


def fold_case(dictionary: DataFrame) -> DataFrame:
    """Lower-case keys: a repeated key keeps its first place and its last value."""
    return dictionary.groupBy(F.lower("key").alias("key")).agg(
        F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord")
    )


def dictionary_counts(spark: SparkSession) -> DataFrame:
    """Name and number of entries of every known dictionary."""
    counts = [
        as_dictionary(spark, name).agg(F.count(F.lit(1)).alias("entries"))
        .select(F.lit(name).alias("name"), "entries")
        for name in dictionary_names()
    ]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionAll(one)
    return result


def ordered_pairs(dictionary: DataFrame) -> list[tuple[str, str]] | None:
    """(key, value) in order when the dictionary is small, else ``None``."""
    rows = small_rows(dictionary.select("key", "value", "ord"))
    if rows is None:
        return None
    return [(r["key"], r["value"]) for r in sorted(rows, key=lambda r: (r["ord"], r["key"], r["value"] or ""))]


def numbered(dictionary: DataFrame) -> DataFrame:
    """Replace ``ord`` by its rank inside blocks of equal keys; keeps the order column."""
    return dictionary.withColumn(
        "copy", F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    )
