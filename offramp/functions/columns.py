"""Small helpers for building Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda is evaluated again for every array element. Binding it
    to the variable of an outer one-element ``transform`` keeps it to one evaluation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(col: Column | str) -> Column:
    """The vector as ``ARRAY<DOUBLE>``; inputs may be float, sums are taken in double."""
    return F.col(col).cast("array<double>") if isinstance(col, str) else col.cast("array<double>")


def int_div(a: Column, b: Column | int) -> Column:
    """Whole-number quotient in 64-bit arithmetic. ``/`` would go through doubles, which cannot
    hold large ids and offsets."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name based on ``base`` that the table does not have (in any case)."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name += "_"
    return name
