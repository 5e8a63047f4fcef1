"""Column helpers shared by all operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space in the sense of Unicode: as a pattern, and as characters for trimming.
SPACE = r"(?U)[\s\x1c-\x1f]+"
SPACES = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER_TEXT = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)\s*$"


def col(name: str) -> Column:
    """A column by its exact name; dots, spaces and trailing blanks are literal."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(value) -> list:
    """Accept a list, a JSON text of a list, or a comma separated text."""
    if value is None:
        return []
    if isinstance(value, str):
        text = value.strip()
        if text.startswith(("[", "{")):
            return json.loads(text)
        return [part.strip() for part in text.split(",") if part.strip()]
    return list(value)


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s): {', '.join(missing)}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.btrim(c, F.lit(SPACES))


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE, " "))


def words(c: Column) -> Column:
    """White-space separated tokens, without empty ones."""
    return F.array_remove(F.split(c, SPACE), "")


def _float_text(c: Column) -> Column:
    """Decimal notation where Java prints an exponent (1e7 and above, below 1e-3)."""
    plain = c.cast("string")
    magnitude = F.abs(c)
    positional = F.regexp_replace(
        F.regexp_replace(plain.try_cast("decimal(38,21)").cast("string"), r"0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^([^E]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(plain, r"E(-?\d+)$", 1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(F.isnan(c), F.lit(""))
        .when(~plain.contains("E"), plain)
        .when((magnitude >= 1e-4) & (magnitude < 1e16), positional)
        .otherwise(scientific)
    )


def cell_text(df: DataFrame, name: str) -> Column:
    """The cell as text, null as the empty string."""
    kind = df.schema[name].dataType
    c = col(name)
    if isinstance(kind, T.StringType):
        text = c
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _float_text(c)
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def is_blank(df: DataFrame, name: str) -> Column:
    return strip(cell_text(df, name)) == ""


def to_number(text: Column) -> Column:
    """Numeric value of a text cell, null when it is not a number."""
    value = F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))
    return F.when(~F.isnan(value), value)


def cell_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return to_number(strip(col(name)))
    if isinstance(kind, T.BooleanType):
        return col(name).cast("double")
    if isinstance(kind, T.NumericType):
        value = col(name).cast("double")
        return F.when(~F.isnan(value), value)
    return F.lit(None).cast("double")


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality of two key tuples."""
    condition = F.lit(True)
    for one, other in zip(left, right, strict=True):
        condition = condition & one.eqNullSafe(other)
    return condition
