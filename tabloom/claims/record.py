"""Claims to one wide record per document, and its Dublin Core form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom._columns import cell_text, col, strip, to_number
from tabloom.claims.fields import (
    DUBLIN_CORE, NUMERIC_FIELDS, RECORD_FIELDS, TYPE_SPECIFIC, WHOLE_NUMBERS,
)
from tabloom.claims.rounds import output_name
from tabloom.functions.evidence import dcmi_box, iso_language, scale_source
from tabloom.functions.text import clean_cell, join_nonempty
from tabloom.operators.columns import reorder_type_specific
from tabloom.operators.grouping import MOST_COLUMNS, bounded_values
from tabloom.session import grown


def _coerced(field: str, value: Column) -> Column:
    if field in NUMERIC_FIELDS:
        number = to_number(strip(value))
        return number.cast("bigint") if field in WHOLE_NUMBERS else number
    absent = F.upper(strip(value)) == "N/A"
    return F.when(absent, F.lit("N/A")).otherwise(clean_cell(value))


def type_specific_keys(claims: DataFrame) -> list[str]:
    """The observed free field names that become columns, at most ``MOST_COLUMNS``; ``extra_map`` of
    :func:`wide_records` and :func:`long_extra` take any number of them."""
    names = claims.filter(F.col("field").startswith(TYPE_SPECIFIC)).select("field")
    return bounded_values(names, MOST_COLUMNS, "extra_map or long_extra")


def wide_records(
    claims: DataFrame, documents: DataFrame, keys: list[str] | None = None, failed: DataFrame | None = None,
    extra_map: bool = False,
) -> DataFrame:
    """One row per document: fixed ``map_`` columns, ``ts_`` columns from the data.

    Missing text is '', missing numbers are null; ``map_not_applicable`` lists
    numeric fields answered with ``N/A``. Documents in ``failed`` (doc_id) keep
    empty cells. With ``extra_map`` the free fields are one column ``map_extra``,
    a map from ``ts_`` name to text (empty where there is none), so that the
    schema does not depend on the data and a row holds only its own fields.
    """
    usable = claims if failed is None else claims.join(grown(failed.select("doc_id")), "doc_id", "left_anti")
    specific = [] if extra_map else type_specific_keys(usable) if keys is None else keys

    def value_of(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.coalesce("value", F.lit(""))))

    cells = [_coerced(f, value_of(f)).alias(out) for f, out in RECORD_FIELDS.items()]
    is_scale = F.col("field") == "scale_ratio"
    source = F.max(F.when(is_scale, scale_source(F.col("evidence_text"), F.col("evidence_kind"))))
    refused = F.col("field").isin(*NUMERIC_FIELDS) & (F.upper(strip(F.col("value"))) == "N/A")
    extra = [clean_cell(value_of(f)).alias("ts_" + f[len(TYPE_SPECIFIC):]) for f in specific]
    wide = usable.groupBy("doc_id").agg(
        *cells, source.alias("map_scale_source"),
        F.array_join(F.array_sort(F.collect_set(F.when(refused, F.col("field")))), ", ")
        .alias("map_not_applicable"),
        *extra,
    )
    joined = documents.join(grown(wide), "doc_id", "left")
    if extra_map:
        free = long_extra(usable).groupBy("doc_id", "column").agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))
        entries = free.groupBy("doc_id").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "value")))).alias("map_extra"))
        none = F.create_map().cast("map<string,string>")
        joined = joined.join(grown(entries), "doc_id", "left").withColumn("map_extra", F.coalesce("map_extra", none))
    texts = [
        f.name for f in wide.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name != "doc_id"
    ]
    joined = joined.withColumns({name: F.coalesce(col(name), F.lit("")) for name in texts})
    return reorder_type_specific(joined)


def long_extra(claims: DataFrame) -> DataFrame:
    """Type-specific claims as (doc_id, column, value) when columns would be too many."""
    return claims.filter(F.col("field").startswith(TYPE_SPECIFIC)).select(
        "doc_id", output_name(F.col("field")).alias("column"), clean_cell(F.col("value")).alias("value")
    )


def _number_text(value: Column) -> Column:
    """Shortest text of a double: 38 instead of 38.0, six significant digits."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(value))).cast("int"))
    power = F.pow(F.lit(10.0), digits)
    text = (F.round(value * power) / power).cast("string")
    return F.regexp_replace(text, r"\.0$", "")


def dublin_core(df: DataFrame) -> DataFrame:
    """Append the 17 Dublin Core columns; missing source columns count as empty."""

    def raw(name: str) -> Column:
        return cell_text(df, name) if name in df.columns else F.lit("")

    def given(name: str) -> Column:
        text = raw(name)
        return F.when((strip(text) != "") & (F.upper(strip(text)) != "N/A"), text)

    def kept(name: str) -> Column:
        return F.coalesce(given(name), F.lit(""))

    def number(name: str) -> Column:
        return to_number(strip(raw(name)))

    def labelled(label: str, name: str) -> Column:
        return F.concat(F.lit(label), given(name))

    width, height = number("map_width_cm"), number("map_height_cm")
    size = F.concat(_number_text(width), F.lit(" cm × "), _number_text(height), F.lit(" cm"))
    extent = F.coalesce(F.when((width > 0) & (height > 0), size), F.lit(""))
    box = dcmi_box(*[number(f"map_bbox_{edge}") for edge in ("west", "east", "south", "north")])
    ratio = number("map_scale_ratio").cast("bigint")
    ratio = F.when(ratio != 0, F.concat(F.lit("Scale ratio: 1:"), ratio.cast("string")))
    scale = F.concat_ws(" — ", labelled("Scale: ", "map_scale"), ratio, labelled("Projection: ", "map_projection"))
    description = F.concat_ws(
        " ; ", strip(given("map_description")), F.nullif(scale, F.lit("")),
        labelled("Notes: ", "map_notes"), labelled("Legend: ", "map_legend_content"),
        labelled("Condition: ", "map_condition"),
    )
    year = number("map_date_year").cast("bigint")
    year = F.when(year != 0, year.cast("string"))
    date_text = strip(raw("map_date"))
    kind = F.concat(F.lit("Image; cartographic ("), given("map_type"), F.lit(")"))
    columns = {
        "dc:identifier": raw("filename"),
        "dc:title": kept("map_title"),
        "dc:creator": F.lit(""),
        "dc:publisher": kept("map_publisher"),
        "dc:date": F.coalesce(F.when(~date_text.isin("", "N/A"), date_text), year, F.lit("")),
        "dcterms:created": F.coalesce(year, F.lit("")),
        "dcterms:hasVersion": kept("map_edition"),
        "dc:type": F.coalesce(kind, F.lit("Image; cartographic")),
        "dc:format": F.concat_ws("; ", strip(given("map_medium")), F.nullif(extent, F.lit(""))),
        "dcterms:medium": kept("map_medium"),
        "dcterms:extent": extent,
        "dc:language": iso_language(raw("map_language")),
        "dc:subject": join_nonempty([raw("map_subject"), raw("map_type")], ", "),
        "dc:coverage": join_nonempty(
            [raw(f"map_{n}") for n in ("coverage", "country", "province", "city", "district", "place_names")]
        ),
        "dcterms:spatial": F.concat_ws(
            " | ", F.nullif(box, F.lit("")), strip(given("map_coordinates"))
        ),
        "dc:description": description,
        "dcterms:conformsTo": F.lit("DCMI Metadata Terms"),
    }
    return df.select("*", *[columns[name].alias(name) for name in DUBLIN_CORE])
