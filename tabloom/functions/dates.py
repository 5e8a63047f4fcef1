"""Catalogue dates: brackets, circa, ranges, decades and centuries to one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom._columns import let, strip

# The accepted spellings of a catalogue date, tried in this order.
NO_DATE = r"^[Nn]\.?\s*[Dd]\.?\s*$"
BETWEEN = r"(?i)^between\s+(\d{4})\s+and\s+(\d{4})"
DECADE_RANGE = r"^(\d{3})-\??\s*[-–]\s*\d{3}-"
CIRCA = r"^c[a]?\.?\s*(\d{4})"
YEAR_RANGE = r"^(\d{4})\s*[-–]\s*(\d{2,4})"
YEAR = r"^(\d{4})\s*\??$"
DECADE = r"^(\d{3})-?\??\s*$"
CENTURY = r"^(\d{2})-{1,2}\??\s*$"
ANY_YEAR = r"(\d{4})"


def _decade(group: Column) -> Column:
    return F.concat((group.try_cast("int") * 10).cast("string"), F.lit("s"))


def _century(group: Column) -> Column:
    n = group.try_cast("int") + 1
    teen = (n % 100).isin(11, 12, 13)
    ending = (
        F.when(teen, F.lit("th"))
        .when(n % 10 == 1, F.lit("st"))
        .when(n % 10 == 2, F.lit("nd"))
        .when(n % 10 == 3, F.lit("rd"))
        .otherwise(F.lit("th"))
    )
    return F.concat(n.cast("string"), ending, F.lit(" century"))


def _inner(text: Column) -> Column:
    """Without outer brackets, then without any bracket."""
    outer = F.when(
        text.startswith("[") & text.endswith("]") & (F.length(text) >= 2),
        strip(F.regexp_replace(text, r"^\[|\]$", "")),
    ).otherwise(text)
    return F.regexp_replace(outer, r"[\[\]]", "")


def _rules(text: Column, inner: Column) -> Column:
    def group(pattern: str) -> Column:
        return F.regexp_extract(inner, pattern, 1)

    return (
        F.when(text == "", F.lit(""))
        .when(inner.rlike(NO_DATE), F.lit(""))
        .when(inner.rlike(BETWEEN), group(BETWEEN))
        .when(inner.rlike(DECADE_RANGE), _decade(group(DECADE_RANGE)))
        .when(inner.rlike(CIRCA), group(CIRCA))
        .when(inner.rlike(YEAR_RANGE), group(YEAR_RANGE))
        .when(inner.rlike(YEAR), group(YEAR))
        .when(inner.rlike(DECADE), _decade(group(DECADE)))
        .when(inner.rlike(CENTURY), let(group(CENTURY), _century))
        .when(inner.rlike(ANY_YEAR), group(ANY_YEAR))
        .otherwise(text)
    )


def date(c: Column) -> Column:
    """Year, decade (``1880s``) or century (``20th century``) of a catalogue date."""
    return let(strip(c), lambda text: let(_inner(text), lambda inner: _rules(text, inner)))


def year(c: Column) -> Column:
    """The leading year of a normalised date as an integer."""
    return F.regexp_extract(date(c), r"^(\d{4})", 1).try_cast("int")
