"""Named scalar functions for the normalise operator.

A function is a builder ``(Column, **params) -> Column``. Python scalars can be
registered through :func:`python_function`, which runs them in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions import dates, text

Builder = Callable[..., Column]

_FUNCTIONS: dict[str, Builder] = {
    "trim": text.trim,
    "lowercase": text.lowercase,
    "uppercase": text.uppercase,
    "title_case": text.title_case,
    "strip_html": text.strip_html,
    "number": text.number,
    "date": dates.date,
    "regex_extract": text.regex_extract,
    "find_replace": text.find_replace,
    "fix_encoding": text.fix_encoding,
    "scale": text.scale,
    "call_number": text.call_number,
    "description_isbd": text.description_isbd,
    "clean_cell": text.clean_cell,
    "list_text": text.list_text,
}


def register_function(name: str, builder: Builder) -> None:
    _FUNCTIONS[name] = builder


def get_function(name: str) -> Builder | None:
    return _FUNCTIONS.get(name)


def function_names() -> list[str]:
    return sorted(_FUNCTIONS)


def python_function(fn: Callable[..., object], returns: str = "string") -> Builder:
    """Wrap a plain Python scalar as a builder; values travel in Arrow batches."""

    def builder(c: Column, **params) -> Column:
        @F.pandas_udf(returns)
        def apply(values: pd.Series) -> pd.Series:
            return values.map(lambda v: fn(v, **params))

        return apply(c)

    return builder
