"""Text cleaning functions. Input is a string column without nulls."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom._columns import collapse_space, let, strip, words


def trim(c: Column) -> Column:
    return collapse_space(c)


def lowercase(c: Column) -> Column:
    return strip(F.lower(c))


def uppercase(c: Column) -> Column:
    return strip(F.upper(c))


def title_case(c: Column) -> Column:
    """Capital at the start of every run of letters, lower case inside it."""
    runs = F.regexp_extract_all(F.lower(strip(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def strip_html(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"<[^>]+>", ""))


def number(c: Column) -> Column:
    """First number in the text, null when there is none."""
    return F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def regex_extract(c: Column, pattern: str = "") -> Column:
    """Group 1 when the pattern has groups, else the whole match; no match gives ''."""
    if not pattern:
        return c
    group = 1 if re.compile(pattern).groups else 0
    return F.coalesce(F.regexp_extract(c, pattern, group), F.lit(""))


def find_replace(c: Column, find: str = "", replace: str = "") -> Column:
    if not find:
        raise ValueError("find_replace needs a non-empty 'find'")
    return F.replace(c, F.lit(find), F.lit(replace))


def fix_encoding(c: Column) -> Column:
    """Drop replacement characters and the double blanks they leave."""
    return strip(F.regexp_replace(F.translate(c, "�", ""), r"  +", " "))


def clean_cell(c: Column) -> Column:
    """One-line cell: line breaks and tabs become blanks, blank runs collapse."""
    flat = F.regexp_replace(c, r"\r\n|\r|\n|\t", " ")
    return strip(F.regexp_replace(flat, r"  +", " "))


def _scale(text: Column) -> Column:
    digits = strip(F.translate(F.regexp_extract(text, r"1\s*:\s*([\d,\s]+)", 1), ", ", ""))

    def grouped(found: Column) -> Column:
        plain = F.regexp_replace(found, r"^0+(?=\d)", "")
        commas = F.regexp_replace(plain, r"(?<=\d)(?=(?:\d{3})+$)", ",")
        return F.when(found.rlike(r"^\d+$"), F.concat(F.lit("1:"), commas)).otherwise(text)

    return let(digits, grouped)


def scale(c: Column) -> Column:
    """``1 : 63,360`` becomes ``1:63,360``; anything else stays."""
    return let(strip(c), _scale)


def call_number(c: Column) -> Column:
    """The first two white-space tokens; a single token stays as it is."""
    return let(
        words(c),
        lambda parts: F.when(
            F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), " ")
        ).otherwise(F.array_join(parts, " ")),
    )


def _isbd(text: Column) -> Column:
    found = F.regexp_extract(text, r"^(\d+)\s+maps?", 1)
    count = F.when(found == "", F.lit("1")).otherwise(found)
    plural = F.when(F.coalesce(count.try_cast("decimal(38,0)") > 1, F.lit(True)), F.lit("s"))
    colour = F.when(F.lower(text).contains("col"), F.lit("col.")).otherwise(F.lit("b&w"))
    size = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?\s*x\s*\d+(?:\.\d+)?\s*cm)", 1)
    label = F.concat(count, F.lit(" map"), F.coalesce(plural, F.lit("")))
    joined = F.concat_ws(" ; ", label, colour, F.nullif(size, F.lit("")))
    return F.when(text == "", F.lit("")).otherwise(joined)


def description_isbd(c: Column) -> Column:
    """``n map(s) ; col.|b&w ; WxH cm`` from a free-text description."""
    return let(strip(c), _isbd)


def list_text(c: Column, separator: str = ", ") -> Column:
    """Join a text that holds a list literal, e.g. ``['a', 'b']`` becomes ``a, b``."""
    text = strip(c)
    items = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    kept = F.filter(items, lambda v: v.isNotNull() & ~v.isin("", "0", "None", "False", "false"))
    looks_like_list = text.startswith("[") & text.endswith("]")
    return F.when(looks_like_list & items.isNotNull(), F.array_join(kept, separator)).otherwise(text)


def array_text(c: Column, separator: str = ", ") -> Column:
    """Join the non-empty items of an array column."""
    kept = F.filter(c, lambda v: v.isNotNull() & (v.cast("string") != ""))
    return F.coalesce(F.array_join(kept, separator), F.lit(""))


def join_nonempty(values: list[Column], separator: str = "; ") -> Column:
    """Distinct non-empty values in order; ``N/A`` counts as empty."""
    cleaned = F.array(*[strip(F.coalesce(v.cast("string"), F.lit(""))) for v in values])
    kept = F.filter(cleaned, lambda v: (v != "") & (F.upper(v) != "N/A"))
    return F.array_join(F.array_distinct(kept), separator)
