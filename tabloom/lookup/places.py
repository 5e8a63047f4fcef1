"""Area code of a row from its place columns, most specific column first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom._columns import as_list, cell_text, col, strip
from tabloom.lookup import substrings
from tabloom.lookup.tables import as_dictionary, ordered_pairs

STAGE_EXACT, STAGE_PART, STAGE_INSIDE = 0, 1, 2
PART_SEPARATORS = r"[,;/&]"


def place_text(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.lower(F.coalesce(F.array_join(col(name), " "), F.lit("")))
    return F.lower(strip(cell_text(df, name)))


def match_area(
    df: DataFrame,
    geo_columns,
    output_column: str = "bl_area_matched",
    min_match_length: int = 5,
    places="place_to_bl_area",
) -> DataFrame:
    """First column with a hit decides: the whole cell, else its longest known
    part, else the longest known name inside it of at least the given length.
    Equal lengths go to the larger code.
    """
    names = [c for c in as_list(geo_columns) if c in df.columns]
    table = as_dictionary(df.sparkSession, places)
    pairs = ordered_pairs(table)
    if not names:
        return df.withColumn(output_column, F.lit(""))
    if pairs is None:
        return _match_large(df, names, output_column, min_match_length, table)
    codes = dict(pairs)
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]) if codes else None
    long_names = [(k, v) for k, v in codes.items() if len(k) >= min_match_length]
    chosen = F.lit("")
    for name in reversed(names):
        text = place_text(df, name)
        if known is None:
            continue
        parts = F.transform(
            F.split(text, PART_SEPARATORS),
            lambda p: F.struct(
                F.length(strip(p)).alias("n"), F.try_element_at(known, strip(p)).alias("v")
            ),
        )
        part = F.array_max(F.filter(parts, lambda p: p["v"].isNotNull()))["v"]
        hit = F.coalesce(
            F.try_element_at(known, text), part, substrings.longest_hit(text, long_names)
        )
        chosen = F.coalesce(F.when(text != "", hit), chosen)
    return df.withColumn(output_column, chosen)


def _match_large(
    df: DataFrame, names: list[str], output: str, min_length: int, places: DataFrame
) -> DataFrame:
    """The same decision by joins: candidates of all distinct cells, best one per cell."""
    known = places.groupBy("key").agg(F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))
    cells = None
    for name in names:
        one = df.select(place_text(df, name).alias("text"))
        cells = one if cells is None else cells.unionAll(one)
    cells = cells.filter("text <> ''").distinct()
    exact = cells.join(known, cells["text"] == known["key"]).select(
        F.md5("text").alias("digest"), F.lit(STAGE_EXACT).alias("stage"), F.length("text").alias("n"), "value"
    )
    parts = cells.select(
        F.md5("text").alias("digest"), F.split("text", PART_SEPARATORS).alias("parts")
    ).select("digest", F.explode("parts").alias("part")).select("digest", strip(F.col("part")).alias("key"))
    part = parts.join(known, "key").select(
        "digest", F.lit(STAGE_PART).alias("stage"), F.length("key").alias("n"), "value"
    )
    inside = substrings.hits(cells, known.filter(F.length("key") >= min_length)).select(
        "digest", F.lit(STAGE_INSIDE).alias("stage"), F.length("key").alias("n"), "value"
    )
    rank = F.struct((-F.col("stage")).alias("s"), "n", "value")
    best = exact.unionAll(part).unionAll(inside).groupBy("digest").agg(
        F.max(rank)["value"].alias("_code")
    )
    result, found = df, []
    for i, name in enumerate(names):
        side = best.select(F.col("digest").alias(f"_d{i}"), F.col("_code").alias(f"_c{i}"))
        result = result.join(side, F.md5(place_text(df, name)) == F.col(f"_d{i}"), "left")
        found.append(F.col(f"_c{i}"))
    result = result.withColumn(output, F.coalesce(*found, F.lit("")))
    return result.drop(*[f"_{p}{i}" for p in "dc" for i in range(len(names))])
