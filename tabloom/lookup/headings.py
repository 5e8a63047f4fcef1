"""Subject headings of a row from country, state, city and theme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom._columns import cell_text, col
from tabloom.functions.text import array_text, list_text
from tabloom.lookup.fixed_values import HEADING_TEMPLATES, THEME_SUBDIVISIONS


def _part(df: DataFrame, name: str | None) -> Column:
    if not name or name not in df.columns:
        return F.lit("")
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return array_text(col(name))
    return list_text(cell_text(df, name))


def subject_headings(
    df: DataFrame,
    country_col: str,
    state_col: str | None = None,
    city_col: str | None = None,
    theme_col: str | None = None,
    output_column: str = "subject_lcsh",
    templates: dict | None = None,
    subdivisions: dict | None = None,
) -> DataFrame:
    """Locality heading, its theme subdivision, then state and country headings."""
    country, state = _part(df, country_col), _part(df, state_col)
    city, theme = _part(df, city_col), _part(df, theme_col)
    filled = [F.when(x != "", x) for x in (city, state, country)]
    locality = F.coalesce(*filled)
    area = None
    for (one_country, one_state), pattern in (templates or HEADING_TEMPLATES).items():
        hit = (country == one_country) & (state == (one_state or ""))
        pieces = pattern.split("{locality}")
        text = F.lit(pieces[0])
        for piece in pieces[1:]:
            text = F.concat(text, locality, F.lit(piece))
        area = F.when(hit, text) if area is None else area.when(hit, text)
    area = locality if area is None else area.otherwise(locality)
    area = F.when(locality.isNotNull(), area)
    division = None
    for word, label in (subdivisions or THEME_SUBDIVISIONS).items():
        hit = F.lower(theme).contains(word)
        division = F.when(hit, F.lit(label)) if division is None else division.when(hit, F.lit(label))
    headings = F.array(
        F.concat(area, F.lit(" -- Maps")),
        F.concat(area, F.lit(" -- "), division) if division is not None else F.lit(None),
        F.when((state != "") & (city != ""), F.concat(state, F.lit(" -- Maps"))),
        F.when((country != "") & (country != city), F.concat(country, F.lit(" -- Maps"))),
    )
    return df.withColumn(
        output_column, F.array_join(F.array_distinct(F.array_compact(headings)), "; ")
    )
