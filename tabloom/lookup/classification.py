"""Shelf marks: area and subject codes with descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom._columns import cell_text, strip, words
from tabloom.lookup.fixed_values import AREA_CODES, SUBJECT_CODES


def _code_map(codes: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])


def area_description(code: Column, codes: dict[str, str] | None = None) -> Column:
    """The code itself, else its part before the point, else its hundred, else ''."""
    known = _code_map(codes or AREA_CODES)
    parts = F.split(code, r"\.", -1)
    whole, sub = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    base = F.when(F.size(parts) == 2, F.try_element_at(known, whole))
    number = F.when(code.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), code.try_cast("double"))
    hundred = (F.floor(F.floor(F.abs(number)) / 100) * 100).cast("bigint").cast("string")
    hundred = F.when(number >= 0, hundred)
    return F.coalesce(
        F.try_element_at(known, code),
        F.concat(base, F.lit(" (sub-area ."), sub, F.lit(")")),
        F.concat(F.try_element_at(known, hundred), F.lit(" (sub-area "), code, F.lit(")")),
        F.lit(""),
    )


def subject_description(code: Column, codes: dict[str, str] | None = None) -> Column:
    """The code itself, else its first letter, else ''."""
    known = _code_map(codes or SUBJECT_CODES)
    letter = F.when(code != "", F.substring(code, 1, 1))
    return F.coalesce(
        F.try_element_at(known, code),
        F.concat(F.try_element_at(known, letter), F.lit(" ("), code, F.lit(")")),
        F.lit(""),
    )


def parse_shelf_mark(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Add area and subject code, their descriptions and whether both are present."""
    parts = words(cell_text(df, column))
    area = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    second = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    subject = F.when(second.rlike(r"^\p{L}"), second).otherwise(F.lit(""))
    return df.withColumns(
        {
            f"{prefix}raw": strip(cell_text(df, column)),
            f"{prefix}area_code": area,
            f"{prefix}area_description": area_description(area),
            f"{prefix}subject_code": subject,
            f"{prefix}subject_description": subject_description(subject),
            f"{prefix}is_valid": (area != "") & (subject != ""),
        }
    )
