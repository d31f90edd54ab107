"""Helpers for long computed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either(condition: Column, yes: Column, no: Column | None = None) -> Column:
    """``IF``. Lambdas are not compiled, and there it takes a fraction of the time of a ``CASE``."""
    return F.call_function("if", condition, yes, F.lit(None) if no is None else no)


def settle(frame: DataFrame, column: str) -> DataFrame:
    """Turn a computed column into a generated one (an ``explode`` of one element).

    A filter above a projection is pushed below it by copying the projected expression, and
    exploding an array adds such filters by itself. For a long expression, or a chain of them,
    the copies multiply, in the plan and at run time. Filters on a generator's output stay above
    it, so the expression is planned and evaluated once. The step adds no exchange.
    """
    others = [c for c in frame.columns if c != column]
    return frame.select(*others, F.explode(F.array(column)).alias(column)).select(*frame.columns)
