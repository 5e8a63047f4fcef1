"""Filters with two ports, rule routers, presence and missing-cell predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom._columns import (
    as_list, cell_number, cell_text, is_blank, require, strip,
)

ROUTES = ("route_1", "route_2", "route_3", "route_4", "default")


def filter_predicate(df: DataFrame, column: str, operator: str, value: str = "") -> Column:
    """Predicate of the two-port filter; never null.

    ``equals`` is case-sensitive, ``contains`` is a case-insensitive regular
    expression, ``regex`` is anchored at the start only.
    """
    require(df, [column])
    text = cell_text(df, column)
    if operator == "equals":
        return text == F.lit(value)
    if operator == "not_equals":
        return text != F.lit(value)
    if operator == "contains":
        return text.rlike("(?i)" + value)
    if operator == "not_contains":
        return ~text.rlike("(?i)" + value)
    if operator == "is_empty":
        return text == ""
    if operator == "is_not_empty":
        return text != ""
    if operator == "regex":
        return text.rlike(f"^(?:{value})")
    if operator == "greater_than":
        return F.coalesce(cell_number(df, column) > float(value), F.lit(False))
    if operator == "less_than":
        return F.coalesce(cell_number(df, column) < float(value), F.lit(False))
    raise ValueError(f"unknown operator: {operator}")


def filter_rows(df: DataFrame, column: str, operator: str, value: str = "") -> dict[str, DataFrame]:
    """Split into ``matched`` and ``unmatched``; together they are the input."""
    hit = filter_predicate(df, column, operator, value)
    return {"matched": df.filter(hit), "unmatched": df.filter(~hit)}


_ORDERING = {
    ">=": lambda a, b: a >= b, "greater_equal": lambda a, b: a >= b,
    ">": lambda a, b: a > b, "greater_than": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, "less_equal": lambda a, b: a <= b,
    "<": lambda a, b: a < b, "less_than": lambda a, b: a < b,
}


def _as_float(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def condition(df: DataFrame, rule: dict) -> Column:
    """One router condition: literal, case-insensitive text tests and number tests."""
    column = rule.get("column", "")
    operator = rule.get("op") or rule.get("operator") or "equals"
    value = str(rule.get("value", ""))
    if column not in df.columns:
        return F.lit(False)
    text = cell_text(df, column)
    if operator == "equals":
        return F.lower(text) == F.lit(value.lower())
    if operator == "not_equals":
        return F.lower(text) != F.lit(value.lower())
    if operator == "contains":
        return F.lower(text).contains(value.lower())
    if operator == "not_contains":
        return ~F.lower(text).contains(value.lower())
    if operator == "is_empty":
        return strip(text) == ""
    if operator == "is_not_empty":
        return strip(text) != ""
    if operator == "regex":
        return text.rlike(value)
    bound = _as_float(value)
    if operator in _ORDERING and bound is not None:
        return F.coalesce(_ORDERING[operator](cell_number(df, column), F.lit(bound)), F.lit(False))
    return F.lit(False)


def route_column(df: DataFrame, rules) -> Column:
    """Name of the first rule all of whose conditions hold, else ``default``."""
    chosen = None
    for rule in as_list(rules):
        output = rule.get("output", "default")
        if output not in ROUTES:
            raise ValueError(f"unknown route: {output}")
        hit = F.lit(True)
        for one in rule.get("conditions") or []:
            hit = hit & condition(df, one)
        chosen = F.when(hit, F.lit(output)) if chosen is None else chosen.when(hit, F.lit(output))
    return F.lit("default") if chosen is None else chosen.otherwise(F.lit("default"))


def tagged(df: DataFrame, rules, port: str = "_port") -> DataFrame:
    """Every row with the name of its port, so that all ports can be read or written in one pass."""
    return df.withColumn(port, route_column(df, rules))


def route(df: DataFrame, rules) -> dict[str, DataFrame]:
    """Five ports; each is a filter on the same row-wise expression, no shuffle."""
    chosen = route_column(df, rules)
    return {name: df.filter(chosen == name) for name in ROUTES}


def has_path(df: DataFrame, column: str) -> Column:
    """The cell names a file: not null, not blank, not the text ``nan``."""
    require(df, [column])
    text = strip(cell_text(df, column))
    return (text != "") & (F.lower(text) != "nan")


def missing_fields(df: DataFrame, fields, only_empty: bool = True) -> Column:
    """Names of the target fields that still have to be filled, in order."""
    names = [f["column"] if isinstance(f, dict) else f for f in as_list(fields)]
    flags = []
    for name in names:
        absent = F.lit(True) if not only_empty or name not in df.columns else is_blank(df, name)
        flags.append(F.struct(F.lit(name).alias("name"), absent.alias("absent")))
    if not flags:
        return F.array().cast("array<string>")
    return F.transform(F.filter(F.array(*flags), lambda f: f["absent"]), lambda f: f["name"])
