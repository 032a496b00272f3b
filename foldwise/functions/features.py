"""Derived feature expressions. Each takes and returns Columns, so Catalyst sees all of it.

A zero divisor gives NULL (and not an error or an infinity); a NULL input gives NULL. What a
learner then does with NULL is decided in one place, ``foldwise.functions.nulls``.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``."""
    return F.try_divide(numerator, denominator)


def rate(numerator: Column, count: Column) -> Column:
    """``numerator / (count + 1)``: the offset keeps a count of zero defined."""
    return F.try_divide(numerator, count + F.lit(1))


def flag_above(value: Column, threshold: float) -> Column:
    """1 where ``value`` is strictly above the threshold, else 0, also for NaN; NULL for NULL."""
    return ((value > F.lit(threshold)) & ~F.isnan(value.cast("double"))).cast("int")


def interaction(left: Column, right: Column) -> Column:
    """Product of two columns."""
    return left * right


def mean_of(*columns: Column) -> Column:
    """Arithmetic mean across columns, added up in the order given."""
    return reduce(add, columns) / F.lit(len(columns))
