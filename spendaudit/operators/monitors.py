"""Scheduled monitors, made replayable: every relative-time predicate
(today, yesterday, last 24 h, last 7/14 days) is driven by an explicit
``as_of`` date or ``as_of_ts`` timestamp instead of the clock.

Time windows are half-open ``[as_of - n days, as_of + 1 day)`` (everything
up to the end of the run day) and go through ``within``, so a source
partitioned by ``usage_date`` reads only the days it needs.  The daily
anomaly alert's 7-row baseline may reach arbitrarily far back over missing
days; it reads a recent window and goes further back only for the
workspaces that need it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions.classify import (attribution_category, date_lit, deviation, is_weekend,
                                  ladder, within)
from ..functions.money import cv_pct, money_round, money_sum, ratio, rounded
from ..functions.sieve import sieve, sift
from ..schema import (GPU_SKUS, INTERACTIVE_SKUS, LARGE_GPU_INSTANCES, PIPELINE_SKU,
                      SQL_SKUS)
from .audits import ALERT_RUNGS, daily_spend, densify_days, with_baseline
from .rollup import moments_stddev


def _day(d) -> dt.date:
    return d.date() if isinstance(d, dt.datetime) else d


def _days_back(as_of, days: int) -> tuple[dt.date, dt.date]:
    a = _day(as_of)
    return a - dt.timedelta(days=days), a + dt.timedelta(days=1)


# --------------------------------------------------------------------- M1
def nightly_idle_sweep(usage: DataFrame | None, day, *, terminate_hours: int = 12,
                       warn_hours: int = 6, clusters: DataFrame | None = None) -> DataFrame:
    """Interactive clusters of one day with no productive (job) hour or with
    auto-termination disabled.  With ``clusters`` (the roll-up's daily cluster
    rows) that day's rows are merged from exact moments."""
    d = _day(day)
    keys = ("cluster_id", "cluster_name", "workspace_id")
    if clusters is not None:
        g = clusters.where(F.col("usage_date") == date_lit(d)).groupBy(*keys).agg(
            F.sum("hours").alias("hours_active"),
            F.sum(F.when(F.col("job_id").isNotNull(), F.col("hours")).otherwise(0))
            .alias("productive_hours"),
            F.sum("cost_usd").alias("_cost"), F.min("autotermination_min").alias("min_autoterm"),
            F.sum("q_count").alias("_n"), F.sum("q_sum").alias("_dbus"),
            F.sum("q_squares").alias("_squares"))
        g = g.withColumn("_sd", moments_stddev("_n", "_dbus", "_squares"))
    else:
        src = (within(usage.filter(F.col("sku_name").isin(*INTERACTIVE_SKUS)),
                      lo=d, hi=d + dt.timedelta(days=1))
               .select("workspace_id", "usage_quantity", "estimated_cost_usd",
                       M.parsed().alias(M.META_COL)))
        q = F.col("usage_quantity")
        g = src.groupBy(M.field("cluster_id").alias("cluster_id"),
                        M.field("cluster_name").alias("cluster_name"), "workspace_id").agg(
            F.count(F.lit(1)).alias("hours_active"),
            F.count_if(M.field("job_id").isNotNull()).alias("productive_hours"),
            F.sum("estimated_cost_usd").alias("_cost"),
            F.min(M.int_field("autotermination_minutes")).alias("min_autoterm"),
            F.count(q).alias("_n"), F.sum(q).alias("_dbus"),
            F.stddev_samp(q.cast("double")).alias("_sd"))
    g = g.withColumn("cv_pct", rounded(cv_pct(F.col("_sd"), ratio("_dbus", "_n")), 2))
    idle = F.col("productive_hours") == 0
    hours, auto = F.col("hours_active"), F.col("min_autoterm")
    return (g.filter(idle | (auto == 0))
            .select("cluster_id", "cluster_name", "workspace_id", "hours_active",
                    "productive_hours", money_round("_cost", 2).alias("cost_today_usd"),
                    "cv_pct", "min_autoterm",
                    ladder([(idle & (hours >= terminate_hours) & (auto == 0), "CRITICAL"),
                            (idle & (hours >= terminate_hours), "TERMINATE"),
                            (idle & (hours >= warn_hours), "WARN"),
                            (auto == 0, "GOVERNANCE")], "HEALTHY").alias("action_required"),
                    rounded(ratio("_cost", "hours_active") * 24, 2).alias("projected_24h_cost_usd"),
                    "_cost")
            .orderBy(F.desc_nulls_last("_cost"), "workspace_id", "cluster_id")
            .drop("_cost"))


# --------------------------------------------------------------------- M2
def warehouse_hourly(usage: DataFrame, lo=None, hi=None) -> DataFrame:
    """SQL-warehouse cost per hour bucket, workspace and warehouse."""
    src = (within(usage.filter(F.col("sku_name").isin(*SQL_SKUS)), lo=lo, hi=hi)
           .select("workspace_id", "usage_start_time", "usage_quantity", "estimated_cost_usd",
                   M.parsed().alias(M.META_COL)))
    return src.groupBy(F.date_trunc("hour", "usage_start_time").alias("hour_bucket"),
                       "workspace_id",
                       M.field("warehouse_id").alias("warehouse_id"),
                       M.field("warehouse_name").alias("warehouse_name")).agg(
        F.sum("usage_quantity").alias("_dbus"),
        F.sum("estimated_cost_usd").alias("_hc"),
        F.sum(M.long_field("query_count_hourly")).alias("total_queries"))


def spike_report(judged: DataFrame, warn_x: float = 2.0, critical_x: float = 5.0,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Spike rows of hourly rows whose ``hourly_cost`` is above ``warn_x`` times their
    baseline ``_base``."""
    cost, avg = F.col("hourly_cost"), F.col("_base")
    return (judged.filter(cost > avg * warn_x)
            .select("hour_bucket", "workspace_id", "warehouse_name", "hourly_cost",
                    rounded(avg, 4).alias("avg_24h_cost"), "total_queries",
                    rounded(F.try_divide(cost - avg, avg) * 100, 1).alias("pct_above_baseline"),
                    ladder([(cost > avg * critical_x, "CRITICAL"),
                            (cost > avg * warn_x, "WARNING")], "NORMAL").alias("alert_level"),
                    *carry))


def hourly_spikes(hourly: DataFrame, *, baseline_rows: int = 24, warn_x: float = 2.0,
                  critical_x: float = 5.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Spike rows of warehouse-hour aggregates (``warehouse_hourly`` output):
    hourly cost above ``warn_x`` times the mean of the warehouse's previous
    ``baseline_rows`` hour rows.  Rows of one warehouse are ordered by
    (hour, workspace, name) so the frame is deterministic when a warehouse id
    carries several names."""
    w = (Window.partitionBy("warehouse_id")
         .orderBy("hour_bucket", "workspace_id", "warehouse_name")
         .rowsBetween(-baseline_rows, -1))
    base = ratio(F.sum("_hc").over(w), F.count("_hc").over(w))
    return spike_report(hourly.withColumn("hourly_cost", F.col("_hc").cast("double"))
                        .withColumn("_base", base), warn_x, critical_x, carry)


def warehouse_hourly_spikes(usage: DataFrame, as_of_ts, *, window_hours: int = 24,
                            baseline_rows: int = 24, warn_x: float = 2.0,
                            critical_x: float = 5.0) -> DataFrame:
    """Warehouse hours of the last ``window_hours`` before ``as_of_ts`` whose
    cost exceeds ``warn_x`` times the warehouse's trailing baseline."""
    lo = as_of_ts - dt.timedelta(hours=window_hours)
    h = warehouse_hourly(usage, lo, as_of_ts)
    return (hourly_spikes(h, baseline_rows=baseline_rows, warn_x=warn_x, critical_x=critical_x)
            .orderBy(F.desc_nulls_last("pct_above_baseline")))


# --------------------------------------------------------------------- M3
def gpu_utilization(usage: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Average GPU utilisation per GPU job over the last ``days`` days."""
    lo, hi = _days_back(as_of, days)
    src = (within(usage.filter(F.col("sku_name").isin(*GPU_SKUS)), lo=lo, hi=hi)
           .select("workspace_id", "estimated_cost_usd", M.parsed().alias(M.META_COL)))
    g = src.groupBy("workspace_id",
                    M.field("job_name").alias("job_name"),
                    M.field("instance_type").alias("instance_type"),
                    M.field("gpu_type").alias("gpu_type")).agg(
        F.avg(M.double_field("gpu_utilization_pct")).alias("_u"),
        money_sum("estimated_cost_usd").alias("total_cost_7d"),
        F.count(F.lit(1)).alias("job_hours"))
    u = F.col("_u")
    return (g.select("workspace_id", "job_name", "instance_type", "gpu_type",
                     rounded(u, 1).alias("avg_gpu_util_pct"), "total_cost_7d", "job_hours",
                     ladder([(F.col("instance_type").isin(*LARGE_GPU_INSTANCES) & (u < 50), "RIGHT_SIZE"),
                             (u < 35, "CRITICAL"),
                             (u < 60, "WARNING")], "HEALTHY").alias("recommendation"))
            .orderBy(F.asc_nulls_last("avg_gpu_util_pct")))


# --------------------------------------------------------------------- M4
def weekend_spend(usage: DataFrame, as_of, days: int = 7, *, high: float = 500.0,
                  moderate: float = 100.0) -> DataFrame:
    """Weekend share of interactive cluster spend (chargeback)."""
    lo, hi = _days_back(as_of, days)
    src = (within(usage.filter(F.col("sku_name").isin(*INTERACTIVE_SKUS)), lo=lo, hi=hi)
           .select("workspace_id", "usage_start_time", "estimated_cost_usd",
                   M.field_of("cluster_name").alias("cluster_name")))
    wk = is_weekend("usage_start_time")
    cost = F.col("estimated_cost_usd")
    g = src.groupBy("workspace_id", "cluster_name").agg(
        F.count_if(wk).alias("weekend_hours"),
        F.sum(F.when(wk, cost).otherwise(F.lit(0))).alias("_wc"),
        F.sum(cost).alias("_tc"))
    wc = F.col("_wc")
    return (g.filter(F.col("weekend_hours") > 0)
            .select("workspace_id", "cluster_name", "weekend_hours",
                    money_round(wc).alias("weekend_cost_usd"),
                    money_round("_tc").alias("total_cost_usd"),
                    rounded(ratio(wc, "_tc") * 100, 1).alias("weekend_pct"),
                    ladder([(wc > high, "HIGH"), (wc > moderate, "MODERATE")], "NORMAL").alias("flag"))
            .orderBy(F.desc_nulls_last("weekend_cost_usd")))


# --------------------------------------------------------------------- M5
def pipeline_daily(usage: DataFrame, as_of, days: int = 7, savings_share: float = 0.60
                   ) -> DataFrame:
    """Per-day pipeline activity with idle rate and projected cost."""
    lo, hi = _days_back(as_of, days)
    src = (within(usage.filter(F.col("sku_name") == PIPELINE_SKU), lo=lo, hi=hi)
           .select("workspace_id", "usage_start_time", "estimated_cost_usd",
                   M.parsed().alias(M.META_COL))
           .filter(M.field("pipeline_id").isNotNull()))
    gb = M.double_field("data_processed_gb")
    g = src.groupBy(F.to_date("usage_start_time").alias("usage_date"), "workspace_id",
                    M.field("pipeline_id").alias("pipeline_id"),
                    M.field("pipeline_name").alias("pipeline_name"),
                    M.field("pipeline_mode").alias("pipeline_mode")).agg(
        F.count(F.lit(1)).alias("active_hours"),
        money_sum("estimated_cost_usd").alias("daily_cost"),
        F.sum(F.when(gb == 0, F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias("idle_hours"),
        rounded(F.sum(gb), 2).alias("data_processed_gb"))
    idle = ratio("idle_hours", "active_hours")
    continuous = F.col("pipeline_mode") == "CONTINUOUS"
    daily = F.col("daily_cost")
    return (g.withColumn("idle_rate_pct", rounded(idle * 100, 1))
            .withColumn("projected_annual_cost", rounded(daily * 365, 2))
            .withColumn("recoverable_daily", rounded(daily * savings_share, 2))
            .withColumn("status", ladder([(continuous & (idle > 0.50), "CRITICAL"),
                                          (continuous & (idle > 0.25), "HIGH"),
                                          (continuous, "REVIEW")], "NORMAL"))
            .orderBy(F.desc_nulls_last("daily_cost")))


# --------------------------------------------------------------------- M6
def daily_alert(usage: DataFrame | None, as_of, lookback: int = 7,
                recent_days: int | None = 35, *, rollup: DataFrame | None = None,
                dense_days: bool = False) -> DataFrame:
    """Yesterday's spend per workspace against its trailing 7-row baseline;
    every alert level is reported (NORMAL included).

    Exact and date-pruned: daily rows are built from the last ``recent_days`` days.  A
    workspace whose ``lookback`` previous daily rows all fall inside that window needs
    nothing older.  The others (new or mostly idle ones) make a filter of fixed size, and
    only usage that passes it is read from older days: where no workspace needs them,
    adaptive execution drops that scan.  ``recent_days=None`` always reads the whole history.
    With ``rollup`` (the daily roll-up table, days x workspaces rows) the
    whole history is read from it instead of the usage fact.
    ``dense_days=True`` counts calendar days (idle days as zero spend); a
    dense frame depends on each workspace's whole calendar, so it reads the
    full history (or the roll-up) rather than the pruned window.
    """
    yesterday = _day(as_of) - dt.timedelta(days=1)
    if dense_days and rollup is None:
        recent_days = None
    if rollup is not None:
        daily = daily_spend(rollup=rollup.filter(F.col("usage_date") <= date_lit(yesterday)),
                            round_dbus=False)
    elif recent_days is None:
        daily = daily_spend(usage, round_dbus=False)
    else:
        lo = yesterday - dt.timedelta(days=recent_days)
        recent = daily_spend(within(usage, lo=lo, hi=yesterday + dt.timedelta(days=1)),
                             round_dbus=False)
        y = date_lit(yesterday)
        short = (recent.groupBy("workspace_id")
                 .agg(F.count_if(F.col("usage_date") < y).alias("n"),
                      F.max((F.col("usage_date") == y).cast("int")).alias("has_y"))
                 .filter((F.col("has_y") == 1) & (F.col("n") < lookback))
                 .select("workspace_id", F.xxhash64("workspace_id").alias("_h")))
        older = daily_spend(sift(within(usage, hi=lo), F.xxhash64("workspace_id"),
                                 sieve(short, "_h")), round_dbus=False)
        # rows that passed by a shared bit belong to workspaces with rows enough: harmless
        daily = recent.unionByName(older)
    b = with_baseline(densify_days(daily) if dense_days else daily, lookback)
    rel, z = deviation("daily_cost", "_base", "_spread")
    return (b.filter(F.col("_base").isNotNull() & (F.col("usage_date") == date_lit(yesterday)))
            .select("usage_date", "workspace_id", "daily_cost",
                    F.col("_base").alias("baseline_7d_avg"),
                    rounded(F.col("daily_cost") - F.col("_base"), 2).alias("delta_usd"),
                    rounded(rel * 100, 1).alias("delta_pct"),
                    rounded(z, 2).alias("z_score"),
                    ladder([(rel > t, lab) for t, lab in ALERT_RUNGS], "NORMAL").alias("alert_level"),
                    "daily_dbus", "sku_count")
            .orderBy(F.desc_nulls_last("delta_pct")))


# --------------------------------------------------------------------- M7
def weekly_attribution(usage: DataFrame, as_of) -> DataFrame:
    """Last 14 days per workspace and attribution category, with this week
    (>= as_of - 7 days) against last week ([as_of - 14, as_of - 7))."""
    a = _day(as_of)
    lo, hi = _days_back(a, 14)
    this_lo, last_lo = a - dt.timedelta(days=7), a - dt.timedelta(days=14)
    day = F.to_date("usage_start_time")
    cost = F.col("estimated_cost_usd")
    this_wk = day >= date_lit(this_lo)
    last_wk = (day >= date_lit(last_lo)) & (day < date_lit(this_lo))
    src = within(usage, lo=lo, hi=hi)
    g = src.groupBy("workspace_id", attribution_category().alias("spend_category")).agg(
        F.count(F.lit(1)).alias("usage_events"),
        money_sum("usage_quantity").alias("total_dbus"),
        money_sum(cost).alias("total_cost"),
        F.sum(F.when(this_wk, cost).otherwise(F.lit(0))).alias("_tw"),
        F.sum(F.when(last_wk, cost).otherwise(F.lit(0))).alias("_lw"))
    return (g.select("workspace_id", "spend_category", "usage_events", "total_dbus", "total_cost",
                     money_round("_tw").alias("cost_this_week"),
                     money_round("_lw").alias("cost_last_week"),
                     money_round(F.col("_tw") - F.col("_lw")).alias("wow_delta_usd"))
            .orderBy(F.desc_nulls_last("total_cost")))
