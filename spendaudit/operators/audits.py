"""The six audit queries over a costed usage DataFrame.

Each takes ``usage`` with ``estimated_cost_usd`` (see ``functions.costing``)
and returns a DataFrame.  All group-bys aggregate partially on the map side,
so a workspace or cluster holding a large share of the rows costs one small
partial row per task, never one huge task.  Windows and global shares only
ever run over already aggregated rows (days x workspaces, or groups).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions.classify import deviation, ladder, spend_category, within
from ..functions.costing import with_list_cost
from ..functions.money import annualize, cv_pct, mean, money_round, money_sum, ratio, rounded
from ..schema import AUDIT_DAYS, INTERACTIVE_SKUS, PIPELINE_SKU
from .rollup import CLUSTER_KEYS, daily_totals, moments_stddev


def _all():
    """Whole-result window; only used after aggregation (<= a few thousand rows)."""
    return Window.partitionBy()


def _share_of_total(raw_cost_col: str, digits: int = 1):
    """Percent of the total over all groups (SUM(SUM(x)) OVER ())."""
    total = F.sum(raw_cost_col).over(_all())
    return rounded(ratio(F.col(raw_cost_col).cast("double") * 100, total), digits)


# --------------------------------------------------------------------- O1
def top_cost_centers(usage: DataFrame, k: int = 5) -> DataFrame:
    """Workspaces ranked by spend, with volume, daily average and share."""
    day = F.to_date("usage_start_time")
    g = usage.groupBy("workspace_id").agg(
        F.count("usage_record_id").alias("total_records"),
        money_sum("usage_quantity").alias("total_dbus"),
        money_sum("estimated_cost_usd").alias("total_cost_usd"),
        rounded(mean("usage_quantity"), 4).alias("avg_dbu_per_record"),
        F.sum("estimated_cost_usd").alias("_cost"),
        F.date_diff(F.max(day), F.min(day)).alias("_span"),
        F.min("usage_start_time").alias("first_usage"),
        F.max("usage_start_time").alias("last_usage"))
    return (g.select(
        "workspace_id", "total_records", "total_dbus", "total_cost_usd", "avg_dbu_per_record",
        rounded(ratio("_cost", "_span"), 2).alias("avg_daily_cost_usd"),
        _share_of_total("_cost").alias("pct_of_total_spend"),
        "first_usage", "last_usage")
        .orderBy(F.desc_nulls_last("total_cost_usd"), F.asc("workspace_id"))
        .limit(k))


# --------------------------------------------------------------------- O2
def sku_breakdown(usage: DataFrame, k: int = 12) -> DataFrame:
    """Spend per SKU with its spend category and share."""
    g = usage.groupBy("sku_name").agg(
        F.count(F.lit(1)).alias("usage_events"),
        money_sum("usage_quantity").alias("total_dbus"),
        money_sum("estimated_cost_usd").alias("total_cost_usd"),
        F.sum("estimated_cost_usd").alias("_cost"))
    return (g.select(
        "sku_name", spend_category().alias("spend_category"), "usage_events",
        "total_dbus", "total_cost_usd",
        _share_of_total("_cost").alias("pct_of_total_spend"),
        rounded(ratio("_cost", "usage_events"), 4).alias("avg_cost_per_event"))
        .orderBy(F.desc_nulls_last("total_cost_usd"), F.asc_nulls_last("sku_name"))
        .limit(k))


# --------------------------------------------------------------------- O3
def cluster_activity(usage: DataFrame | None = None, window_days: int = AUDIT_DAYS, *,
                     clusters: DataFrame | None = None) -> DataFrame:
    """Interactive usage per cluster configuration with flatness (CV); the
    annual projection scales a ``window_days`` total to 365 days.  With
    ``clusters`` (the roll-up's daily cluster rows) the count, mean and
    deviation of the window are merged from exact daily moments."""
    if clusters is not None:
        g = clusters.groupBy(*CLUSTER_KEYS).agg(
            F.sum("hours").alias("_hours"), F.sum("q_count").alias("_n"),
            F.sum("q_sum").alias("_dbus"), F.sum("q_squares").alias("_squares"),
            F.sum("cost_usd").alias("_cost"))
        g = g.withColumn("_sd", moments_stddev("_n", "_dbus", "_squares"))
    else:
        q = F.col("usage_quantity")
        src = (usage.filter(F.col("sku_name").isin(*INTERACTIVE_SKUS))
               .select("workspace_id", "usage_quantity", "estimated_cost_usd",
                       M.parsed().alias(M.META_COL)))
        g = src.groupBy(
            "workspace_id",
            *[M.field(c).alias(c) for c in ("cluster_id", "cluster_name", "job_id")],
            M.int_field("autotermination_minutes").alias("autotermination_min"),
            M.field("data_security_mode").alias("data_security_mode"),
        ).agg(F.count(F.lit(1)).alias("_hours"), F.count(q).alias("_n"), F.sum(q).alias("_dbus"),
              F.sum("estimated_cost_usd").alias("_cost"),
              F.stddev_samp(q.cast("double")).alias("_sd"))
    avg, sd = ratio("_dbus", "_n"), F.col("_sd")
    return g.select(
        *CLUSTER_KEYS, F.col("_hours").alias("total_hours_active"),
        money_round("_dbus").alias("total_dbus"), money_round("_cost").alias("total_cost_usd"),
        rounded(avg, 4).alias("avg_hourly_dbu"), rounded(sd, 4).alias("stddev_hourly_dbu"),
        rounded(cv_pct(sd, avg), 2).alias("usage_cv_pct"),
        rounded(annualize("_cost", window_days), 2).alias("projected_annual_cost"))


IDLE_COLUMNS = ["workspace_id", "cluster_id", "cluster_name", "total_hours_active",
                "total_dbus", "total_cost_usd", "avg_hourly_dbu", "usage_cv_pct",
                "autotermination_min", "data_security_mode", "projected_annual_cost",
                "detection_branch", "zombie_status", "recommended_action"]


def idle_clusters(usage: DataFrame | None = None, *, min_hours: int = 200,
                  critical_hours: int = 400, suspect_hours: int | None = 100,
                  max_cv: float = 10.0, window_days: int = AUDIT_DAYS,
                  clusters: DataFrame | None = None) -> DataFrame:
    """Idle ('zombie') interactive clusters from two detection branches.

    Behavioural: no job, more than ``min_hours`` hours and CV below ``max_cv``.
    Governance: auto-termination disabled and no job.  A cluster in both
    branches yields two rows.  The branches are tagged on the single
    aggregate and exploded (one scan instead of a scan per branch); rows are
    already unique per (group, branch), so no DISTINCT shuffle is needed.
    ``suspect_hours=None`` drops the SUSPECT rung (the ported variant).
    ``clusters`` takes the roll-up's daily cluster rows in place of usage.
    """
    a = cluster_activity(usage, window_days, clusters=clusters)
    no_job = F.col("job_id").isNull()
    hours, cv, auto = F.col("total_hours_active"), F.col("usage_cv_pct"), F.col("autotermination_min")
    behavioural = no_job & (hours > min_hours) & (cv < max_cv)
    governance = (auto == 0) & no_job
    tags = F.filter(F.array(F.when(behavioural, F.lit("BEHAVIORAL")),
                            F.when(governance, F.lit("GOVERNANCE_VIOLATION"))),
                    lambda t: t.isNotNull())
    rungs = [(no_job & (hours > critical_hours) & (cv < max_cv) & (auto == 0), "CRITICAL"),
             (no_job & (hours > min_hours) & (cv < max_cv), "HIGH"),
             (auto == 0, "GOVERNANCE")]
    if suspect_hours is not None:
        rungs.append((no_job & (hours > suspect_hours), "SUSPECT"))
    status = ladder(rungs, "MONITOR")
    action = ladder([(auto == 0, "APPLY_POLICY"),
                     (no_job & (hours > min_hours), "TERMINATE")], "MONITOR")
    return (a.filter(behavioural | governance)
            .withColumn("detection_branch", F.explode(tags))
            .withColumn("zombie_status", status)
            .withColumn("recommended_action", action)
            .select(*IDLE_COLUMNS)
            .orderBy(F.desc_nulls_last("total_cost_usd")))


def idle_clusters_ported(usage: DataFrame, prices: DataFrame, as_of, *,
                         lookback_days: int = AUDIT_DAYS, window_days: int = AUDIT_DAYS) -> DataFrame:
    """Idle clusters on the production schema: raw usage is costed by the
    list-price validity join over the last ``lookback_days`` before
    ``as_of``; no SUSPECT rung."""
    import datetime as dt
    lo = dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=lookback_days)
    costed = with_list_cost(within(usage, lo=lo), prices)
    return idle_clusters(costed, suspect_hours=None, window_days=window_days)


# --------------------------------------------------------------------- O4
EFFICIENCY_COLUMNS = ["workspace_id", "sku_name", "total_cost", "total_dbus",
                      "records_with_jobs", "total_queries", "avg_gpu_util_pct",
                      "avg_data_processed_gb", "cost_per_job_event", "cost_per_query",
                      "efficiency_grade", "gpu_efficiency_flag"]


def compute_efficiency(usage: DataFrame, k: int = 25, min_cost: float = 10.0) -> DataFrame:
    """Cost per productive unit (job record or query) per workspace and SKU."""
    src = usage.select("workspace_id", "sku_name", "usage_quantity", "estimated_cost_usd",
                       M.parsed().alias(M.META_COL))
    g = src.groupBy("workspace_id", "sku_name").agg(
        money_sum("estimated_cost_usd").alias("total_cost"),
        money_sum("usage_quantity").alias("total_dbus"),
        F.count_if(M.field("job_id").isNotNull()).alias("records_with_jobs"),
        F.sum(M.long_field("query_count_hourly")).alias("total_queries"),
        rounded(F.avg(M.double_field("gpu_utilization_pct")), 1).alias("avg_gpu_util_pct"),
        rounded(F.avg(M.double_field("data_processed_gb")), 2).alias("avg_data_processed_gb"))
    jobs, queries, cost = F.col("records_with_jobs"), F.col("total_queries"), F.col("total_cost")
    units = F.greatest(F.coalesce(jobs, F.lit(0)), F.coalesce(queries, F.lit(0)), F.lit(1))
    per_unit = ratio(cost, units)
    util = F.col("avg_gpu_util_pct")
    return (g.filter(cost > min_cost)
            .withColumn("cost_per_job_event", rounded(ratio(cost, jobs), 4))
            .withColumn("cost_per_query", rounded(ratio(cost, queries), 6))
            .withColumn("efficiency_grade", ladder([(per_unit > 5.0, "LOW"),
                                                    (per_unit > 1.0, "MODERATE")], "EFFICIENT"))
            .withColumn("gpu_efficiency_flag", ladder([
                (util.isNotNull() & (util < 35.0), "UNDERUTILIZED"),
                (util.isNotNull() & (util < 60.0), "MODERATE"),
                (util.isNotNull(), "HEALTHY")], None))
            .select(*EFFICIENCY_COLUMNS)
            .orderBy(F.desc_nulls_last("cost_per_job_event"), F.asc("workspace_id"),
                     F.asc("sku_name"))
            .limit(k))


# --------------------------------------------------------------------- O5
def daily_spend(usage: DataFrame | None = None, round_dbus: bool = True, *,
                rollup: DataFrame | None = None) -> DataFrame:
    """(usage_date, workspace_id) -> daily_cost (exact decimal, 2 dp), DBUs,
    distinct SKUs, records; from usage, or from a daily roll-up
    (``operators.rollup``) when one is given."""
    t = rollup if rollup is not None else daily_totals(usage)
    dbus = F.round("dbus", 2) if round_dbus else F.col("dbus")
    return t.select("usage_date", "workspace_id",
                    F.round("cost_usd", 2).alias("_daily"),
                    dbus.cast("double").alias("daily_dbus"),
                    "sku_count", "record_count")


def densify_days(daily: DataFrame) -> DataFrame:
    """Calendar-dense daily rows: every day between a workspace's first and
    last active day, with zero spend and DBUs on idle days.  Both sides of
    the join are aggregated (days x workspaces) rows."""
    span = (daily.groupBy("workspace_id")
            .agg(F.min("usage_date").alias("_lo"), F.max("usage_date").alias("_hi"))
            .select("workspace_id",
                    F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("usage_date")))
    return (span.join(daily, ["workspace_id", "usage_date"], "left")
            .select("usage_date", "workspace_id",
                    F.coalesce("_daily", F.lit(0).cast("decimal(38,2)")).alias("_daily"),
                    F.coalesce("daily_dbus", F.lit(0.0)).alias("daily_dbus"),
                    F.coalesce("sku_count", F.lit(0).cast("bigint")).alias("sku_count"),
                    F.coalesce("record_count", F.lit(0).cast("bigint")).alias("record_count")))


def with_baseline(daily: DataFrame, lookback: int = 7) -> DataFrame:
    """Trailing baseline of the ``lookback`` previous rows (not days) of the
    same workspace: mean and sample stddev of daily cost, rounded to cents.
    Mean and stddev share one window spec, so one sort serves both."""
    w = Window.partitionBy("workspace_id").orderBy("usage_date").rowsBetween(-lookback, -1)
    d = F.col("_daily")
    return (daily
            .withColumn("daily_cost", d.cast("double"))
            .withColumn("_base", rounded(ratio(F.sum(d).over(w), F.count(d).over(w)), 2))
            .withColumn("_spread", rounded(F.stddev_samp(d.cast("double")).over(w), 2)))


ALERT_RUNGS = ((1.50, "EMERGENCY"), (0.75, "CRITICAL"), (0.30, "WARNING"))


def spend_spikes(usage: DataFrame | None = None, lookback: int = 7, threshold: float = 0.30,
                 dense_days: bool = False, *, rollup: DataFrame | None = None) -> DataFrame:
    """Days whose spend exceeds the workspace's trailing mean by > threshold.
    The baseline frame counts daily rows (days without usage are skipped);
    ``dense_days=True`` counts calendar days instead, idle days as zero.
    With ``rollup`` the daily totals are read from the roll-up table."""
    daily = daily_spend(usage, rollup=rollup)
    b = with_baseline(densify_days(daily) if dense_days else daily, lookback)
    rel, z = deviation("daily_cost", "_base", "_spread")
    return (b.filter(F.col("_base").isNotNull() & (rel > threshold))
            .select(
                "usage_date", "workspace_id", "daily_cost",
                F.col("_base").alias("moving_avg_7d"),
                F.col("_spread").alias("stddev_7d"),
                rounded(F.col("daily_cost") - F.col("_base"), 2).alias("cost_delta_usd"),
                rounded(rel * 100, 1).alias("pct_above_avg"),
                rounded(z, 2).alias("z_score"),
                "daily_dbus", "sku_count",
                ladder([(rel > t, lab) for t, lab in ALERT_RUNGS], "NORMAL").alias("alert_level"),
                ladder([(z > 3.0, "EXTREME"), (z > 2.0, "ANOMALY"), (z > 1.5, "ELEVATED")],
                       "NORMAL").alias("statistical_classification"))
            .orderBy(F.desc_nulls_last("pct_above_avg")))


# --------------------------------------------------------------------- O6
PIPELINE_COLUMNS = ["workspace_id", "pipeline_id", "pipeline_name", "pipeline_mode",
                    "trigger_interval", "target_table", "total_hours_active", "idle_hours",
                    "idle_rate_pct", "total_dbus", "total_cost_usd", "total_data_processed_gb",
                    "recoverable_waste_usd", "projected_annual_cost", "annual_savings_if_fixed",
                    "waste_classification", "recommended_fix"]


def pipeline_waste(usage: DataFrame, savings_share: float = 0.60,
                   window_days: int = AUDIT_DAYS) -> DataFrame:
    """Continuous-mode pipelines that mostly process no data."""
    src = (usage.filter(F.col("sku_name") == PIPELINE_SKU)
           .select("workspace_id", "usage_quantity", "estimated_cost_usd",
                   M.parsed().alias(M.META_COL))
           .filter(M.field("pipeline_id").isNotNull()))
    gb = M.double_field("data_processed_gb")
    g = src.groupBy(
        "workspace_id",
        M.field("pipeline_id").alias("pipeline_id"),
        M.field("pipeline_name").alias("pipeline_name"),
        M.field("pipeline_mode").alias("pipeline_mode"),
        M.field("trigger_interval").alias("trigger_interval"),
        M.field("target_table").alias("target_table"),
    ).agg(
        F.count(F.lit(1)).alias("total_hours_active"),
        money_sum("usage_quantity").alias("total_dbus"),
        money_sum("estimated_cost_usd").alias("total_cost_usd"),
        F.count_if(gb == 0).alias("idle_hours"),
        rounded(F.sum(gb), 2).alias("total_data_processed_gb"),
        rounded(annualize(F.sum("estimated_cost_usd"), window_days), 2).alias("projected_annual_cost"))
    idle_rate = rounded(ratio("idle_hours", "total_hours_active") * 100, 1)
    continuous = F.col("pipeline_mode") == "CONTINUOUS"
    rate = F.col("idle_rate_pct")
    return (g.withColumn("idle_rate_pct", idle_rate)
            .withColumn("recoverable_waste_usd", rounded(F.col("total_cost_usd") * savings_share, 2))
            .withColumn("annual_savings_if_fixed",
                        rounded(F.col("projected_annual_cost") * savings_share, 2))
            .withColumn("waste_classification", ladder([
                (continuous & (rate > 50), "HIGH"),
                (continuous & (rate > 25), "MODERATE"),
                (continuous, "REVIEW")], "APPROPRIATE"))
            .withColumn("recommended_fix", ladder([
                (continuous & (rate > 25), "SWITCH_TO_TRIGGERED"),
                (continuous, "VALIDATE_STREAMING")], "NONE"))
            .select(*PIPELINE_COLUMNS)
            .orderBy(F.desc_nulls_last("recoverable_waste_usd")))
