"""Classification expressions: spend taxonomies, severity ladders, calendar
predicates and the deviation trio shared by the spike detectors."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (TAXONOMY_A_AI, TAXONOMY_A_PRODUCTION, TAXONOMY_B_AI,
                      TAXONOMY_B_PRODUCTION, INTERACTIVE_SKUS, SKU_CATALOG)
from .money import col


def ladder(rungs: Sequence[tuple[Column, str | None]], default: str | None) -> Column:
    """First matching rung wins (a searched CASE)."""
    expr = None
    for cond, label in rungs:
        expr = (F.when(cond, F.lit(label)) if expr is None
                else expr.when(cond, F.lit(label)))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def spend_category(sku: str | Column = "sku_name") -> Column:
    """Four-way taxonomy of the SKU breakdown."""
    s = col(sku)
    return ladder([(s.isin(*TAXONOMY_A_PRODUCTION), "Production / Value"),
                   (s.isin(*TAXONOMY_A_AI), "AI / Innovation"),
                   (s.isin(*INTERACTIVE_SKUS), "Interactive / Exploration")],
                  "Platform / Governance")


def chart_category(sku: str | Column = "sku_name") -> Column:
    """Same membership as ``spend_category`` with the chart's short names."""
    s = col(sku)
    return ladder([(s.isin(*TAXONOMY_A_AI), "AI / ML"),
                   (s.isin(*TAXONOMY_A_PRODUCTION), "Production"),
                   (s.isin(*INTERACTIVE_SKUS), "Interactive")],
                  "Platform")


def attribution_category(sku: str | Column = "sku_name") -> Column:
    """Four-way taxonomy of the weekly attribution report."""
    s = col(sku)
    return ladder([(s.isin(*TAXONOMY_B_PRODUCTION), "Production"),
                   (s.isin(*TAXONOMY_B_AI), "AI/ML"),
                   (s.isin(*INTERACTIVE_SKUS), "Interactive")],
                  "Platform")


def catalog_category(sku: str | Column = "sku_name") -> Column:
    """Six-way catalogue category; NULL for an unknown SKU."""
    pairs = []
    for name, _rate, cat in SKU_CATALOG:
        pairs += [F.lit(name), F.lit(cat)]
    return F.create_map(*pairs)[col(sku)]


def is_weekend(ts: str | Column = "usage_start_time") -> Column:
    """Saturday or Sunday of the usage day (Spark: Sunday=1 .. Saturday=7)."""
    return F.dayofweek(F.to_date(col(ts))).isin(1, 7)


def deviation(value: str | Column, baseline: str | Column, spread: str | Column | None = None):
    """(relative excess, z) of ``value`` over ``baseline``; NULL-safe."""
    v, b = col(value), col(baseline)
    rel = F.try_divide(v - b, b)
    z = None if spread is None else F.try_divide(v - b, F.nullif(col(spread), F.lit(0.0)))
    return rel, z


def ts_lit(value) -> Column:
    """A TIMESTAMP literal from a date, datetime or ISO string.

    A naive date/datetime is read as wall-clock time in the *session* time
    zone (like every other date function here), not in the Python process's
    zone; an offset-aware datetime keeps its offset."""
    if isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp")
    if isinstance(value, dt.date):
        return F.lit(value).cast("timestamp")
    return F.lit(str(value)).cast("timestamp")


def date_lit(value) -> Column:
    if isinstance(value, dt.datetime):
        value = value.date()
    if isinstance(value, dt.date):
        return F.lit(value)
    return F.lit(str(value)).cast("date")


def within(df, lo=None, hi=None, ts: str = "usage_start_time"):
    """Half-open time filter ``lo <= ts < hi`` (either bound optional).

    When the table carries a ``usage_date`` partition column the same bounds
    are repeated on it, so a date-partitioned source prunes directories.
    """
    if lo is not None:
        df = df.filter(F.col(ts) >= ts_lit(lo))
        if "usage_date" in df.columns:
            df = df.filter(F.col("usage_date") >= F.to_date(ts_lit(lo)))
    if hi is not None:
        df = df.filter(F.col(ts) < ts_lit(hi))
        if "usage_date" in df.columns:
            df = df.filter(F.col("usage_date") <= F.to_date(ts_lit(hi)))
    return df
