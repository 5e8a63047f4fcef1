"""Computed columns: templates, arithmetic expressions, normalisation, reordering."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom._columns import as_list, cell_number, cell_text, col, is_blank
from tabloom.functions.registry import get_function

# Canonical order of the type-specific columns.
TYPE_SPECIFIC_ORDER = [
    "ts_grid_system", "ts_grid_zone", "ts_grid_interval", "ts_grid_easting_range",
    "ts_grid_northing_range", "ts_magnetic_declination", "ts_coordinate_system", "ts_datum",
    "ts_contour_interval", "ts_elevation_range", "ts_elevation_unit", "ts_highest_point",
    "ts_relief",
    "ts_depth_range", "ts_depth_unit", "ts_tidal_datum", "ts_navigation_aids", "ts_chart_number",
    "ts_rock_types", "ts_geological_period", "ts_stratigraphic_units", "ts_mineral_deposits",
    "ts_lot_numbers", "ts_parish", "ts_hundred", "ts_land_parcels", "ts_surveyor",
    "ts_survey_date", "ts_survey_reference",
    "ts_plan_number", "ts_drawing_number", "ts_engineer", "ts_approval_date",
    "ts_theme", "ts_data_source", "ts_classification_method",
    "ts_star_magnitude_range", "ts_epoch",
]


def template(df: DataFrame, formula: str) -> Column:
    """Text with ``{Column}`` tokens filled from the row; unknown tokens stay."""
    pieces: list[Column] = []
    known = sorted(df.columns, key=len, reverse=True)
    if not known:
        return F.lit(formula)
    token = re.compile("|".join(re.escape("{" + name + "}") for name in known))
    last = 0
    for hit in token.finditer(formula):
        if hit.start() > last:
            pieces.append(F.lit(formula[last : hit.start()]))
        pieces.append(cell_text(df, hit.group(0)[1:-1]))
        last = hit.end()
    if last < len(formula) or not pieces:
        pieces.append(F.lit(formula[last:]))
    return F.concat(*pieces)


def count_filled(df: DataFrame, names: Sequence[str]) -> Column:
    """How many of the named cells hold more than white space; unknown names count 0."""
    total = F.lit(0)
    for name in names:
        if name in df.columns:
            total = total + F.when(is_blank(df, name), F.lit(0)).otherwise(F.lit(1))
    return total


_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)).cast("double"),
    ast.Mod: lambda a, b: a - F.floor(F.try_divide(a, b)) * b,
    ast.Pow: F.pow,
}
_COMPARISON = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


def expression(df: DataFrame, formula: str) -> Column:
    """Arithmetic over ``[Column]`` references and ``count_filled([A],[B])``.

    A null or non-numeric cell counts as 0. Only numbers, the four operations,
    ``// % **``, parentheses and comparisons are accepted; division by zero and
    references to unknown columns give null.
    """
    names: list[str] = []

    def placeholder(hit: re.Match) -> str:
        names.append(hit.group(1))
        return f" _ref{len(names) - 1} "

    tree = ast.parse(re.sub(r"\[([^\]]+)\]", placeholder, formula).strip(), mode="eval")

    def reference(node: ast.expr) -> str:
        if isinstance(node, ast.Name) and node.id.startswith("_ref"):
            return names[int(node.id[4:])]
        raise ValueError(f"unsupported expression: {formula!r}")

    def build(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=bool()):
                raise ValueError(f"unsupported expression: {formula!r}")
            case ast.Constant(value=int() | float() as value):
                return F.lit(float(value))
            case ast.Name():
                name = reference(node)
                if name not in df.columns:
                    return F.lit(None).cast("double")
                return F.coalesce(cell_number(df, name), F.lit(0.0))
            case ast.Call(func=ast.Name(id="count_filled"), args=args, keywords=[]):
                return count_filled(df, [reference(a) for a in args]).cast("double")
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return -build(operand)
            case ast.UnaryOp(op=ast.UAdd(), operand=operand):
                return build(operand)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](build(left), build(right))
            case ast.Compare(left=left, ops=ops, comparators=rest):
                result, current = None, build(left)
                for op, other in zip(ops, map(build, rest), strict=True):
                    if type(op) not in _COMPARISON:
                        raise ValueError(f"unsupported expression: {formula!r}")
                    step = _COMPARISON[type(op)](current, other)
                    result = step if result is None else result & step
                    current = other
                return result
        raise ValueError(f"unsupported expression: {formula!r}")

    return build(tree.body)


def formula(df: DataFrame, output_column: str, formula: str, formula_type: str = "template") -> DataFrame:
    if formula_type == "template":
        return df.withColumn(output_column, template(df, formula))
    if formula_type == "expression":
        return df.withColumn(output_column, expression(df, formula))
    raise ValueError(f"unknown formula type: {formula_type}")


def normalize(df: DataFrame, operations) -> DataFrame:
    """Apply named functions in order; each step sees the columns of the previous one.

    ``column="*"`` means every string column, in place. Steps that name an
    unknown column or function are skipped.
    """
    for step in as_list(operations):
        column = step.get("column", "")
        builder = get_function(step.get("function") or "trim")
        if builder is None:
            continue
        if column == "*":
            targets = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        elif column in df.columns:
            targets = [column]
        else:
            continue
        output = step.get("output_column") or ""
        params = step.get("params") or {}
        df = df.withColumns(
            {
                (output if output and column != "*" else name): builder(cell_text(df, name), **params)
                for name in targets
            }
        )
    return df


def reorder_type_specific(df: DataFrame) -> DataFrame:
    """Other columns first as they are, then ``ts_`` columns in canonical order."""
    position = {name: i for i, name in enumerate(TYPE_SPECIFIC_ORDER)}
    specific = sorted(
        (c for c in df.columns if c.startswith("ts_")),
        key=lambda c: (position.get(c, len(position)), c),
    )
    others = [c for c in df.columns if not c.startswith("ts_")]
    return df.select(*[col(c) for c in others + specific])


def new_columns(inputs: Sequence[DataFrame], output: DataFrame) -> list[str]:
    """Columns of the output that no input has."""
    known = {name for df in inputs for name in df.columns}
    return [name for name in output.columns if name not in known]
