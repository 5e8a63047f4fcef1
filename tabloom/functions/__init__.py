"""Scalar functions as Column builders, and their registry."""

from tabloom.functions.registry import (  # noqa: F401
    function_names,
    get_function,
    python_function,
    register_function,
)
