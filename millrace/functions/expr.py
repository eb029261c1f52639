"""Column expressions whose semantics differ from Spark's own: NaN, division, literals."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def col(name: str) -> Column:
    return F.col(name)


def lit(value) -> Column:
    """A literal; None is a null of type int."""
    return F.lit(None).cast("int") if value is None else F.lit(value)


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero; a zero divisor is an error under ANSI mode."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, b).cast("int")


def ieee_div(a: Column, b: Column | float) -> Column:
    """Division of doubles as IEEE 754 has it: by zero it gives an infinity of the dividend's sign, or NaN for 0/0."""
    a, b = a.cast("double"), (b if isinstance(b, Column) else F.lit(b)).cast("double")
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, F.when(a.isNotNull(), at_zero)).otherwise(F.try_divide(a, b))


def compare(a: Column, op: str, value, double: bool = False) -> Column:
    """a op value, null where a is null. double: NaN meets only !=, as IEEE 754 has it, where Spark has NaN equal to itself and largest.

    The comparison itself stays as it is, so that scans still get it as a pushed filter.
    """
    if op not in COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    value = value if isinstance(value, Column) else F.lit(value)
    plain = COMPARE[op](a, value)
    if not double:
        return plain
    nan = F.isnan(a) | F.isnan(value.cast("double"))
    return a.isNotNull() & (plain | nan) if op == "!=" else plain & ~nan


def without_nan(a: Column) -> Column:
    """a, with null for NaN."""
    return F.when(~F.isnan(a), a)
