"""Exact money arithmetic and guarded ratios.

Costs are summed as ``decimal(18,4)`` (exact, so the result never depends on
how Spark split the input), rounded, then cast to ``double`` for output.
Ratios use ``try_divide`` so ANSI mode never raises on a zero denominator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AUDIT_DAYS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int) -> Column:
    """Round half-up and hand the value out as double.

    Doubles are first fixed to their 10-decimal value, so that a half-way
    value such as 34.565 rounds up regardless of its binary representation
    (and the same way in every SQL engine).
    """
    return F.round(col(c).cast("decimal(38,10)"), digits).cast("double")


def money_sum(c: str | Column, digits: int = 2) -> Column:
    """Exact decimal SUM, rounded to ``digits`` and cast to double."""
    return F.round(F.sum(col(c)), digits).cast("double")


def money_round(c: str | Column, digits: int = 2) -> Column:
    """Round an exact decimal and cast to double."""
    return F.round(col(c), digits).cast("double")


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den in double precision; NULL when den is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def mean(c: str | Column) -> Column:
    """AVG that ignores NULLs, computed from the exact sum."""
    return ratio(F.sum(col(c)), F.count(col(c)))


def annualize(c: str | Column, window_days: int = AUDIT_DAYS) -> Column:
    """Linear projection of a ``window_days`` total to 365 days."""
    return col(c).cast("double") * (365.0 / window_days)


def cv_pct(stddev: Column, avg: Column) -> Column:
    """Coefficient of variation in percent; NULL for a zero or NULL mean."""
    return F.try_divide(stddev, avg) * 100
