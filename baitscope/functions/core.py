"""Generic column helpers shared by the scoring functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v)


def lit_array(values: Sequence) -> Column:
    """Array literal, kept in list order (one parsed SQL expression instead of
    one JVM call per element)."""
    values = list(values)
    if values and all(isinstance(v, str) for v in values):
        return F.expr("array(" + ", ".join(_sql_literal(v) for v in values) + ")")
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable and evaluate ``body`` once per row.

    ``transform(array(v), x -> body(x))[0]`` computes ``v`` a single time even
    when ``body`` uses it in many places (a plain column reference would be
    inlined into every use by the optimizer).
    """
    return F.transform(F.array(value), body).getItem(0)


def py_strip(col: Column) -> Column:
    """Strip leading and trailing Unicode whitespace (like ``str.strip()``)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def blank_to_null(col: Column) -> Column:
    """Header value semantics: stripped text, or NULL when missing/blank."""
    s = py_strip(col)
    return F.when(s != "", s)


def dbl(x) -> Column:
    return F.lit(float(x))


def flag(cond: Column) -> Column:
    """Boolean to 0/1 int, NULL treated as false."""
    return F.when(cond, 1).otherwise(0)


def at(arr: Column, i) -> Column:
    """1-based element access, NULL when out of range (ANSI-safe)."""
    return F.try_element_at(arr, i if isinstance(i, Column) else F.lit(i))
