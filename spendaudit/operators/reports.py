"""Datasets behind the report charts (the drawing itself is not built).

Each aggregates first; the few unpartitioned windows (trailing mean over
days, positions, running totals) then run over tens of rows, never over
usage records.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions.classify import catalog_category, chart_category, date_lit
from ..functions.money import annualize, money_round, money_sum, ratio, rounded
from ..schema import AUDIT_DAYS, GPU_CHART_SKU, WORKSPACES
from .savings import (DEFAULT_RULES, SavingsRule, _masked_sums, _prepared, estimate_savings,
                      waste_rules)

# FIXED VALUES — the spike window highlighted on the burn chart (closed) and
# the idle workspace whose daily average is drawn.
SPIKE_WINDOW = (dt.date(2026, 2, 10), dt.date(2026, 2, 13))
IDLE_WORKSPACE = "ws-zombie-008"
LABELS = {r[0]: r[5] for r in WORKSPACES}
MATRIX_ORDER = ("idle_cluster", "gpu_overprovisioning", "sql_spike", "weekend_dev",
                "continuous_pipeline")


def _all():
    return Window.partitionBy()


# --------------------------------------------------------------------- D1
def daily_burn(usage: DataFrame | None = None, spike_window=SPIKE_WINDOW,
               idle_workspace: str = IDLE_WORKSPACE, window: int = 7, min_periods: int = 4,
               audit_days: int = AUDIT_DAYS, *, rollup: DataFrame | None = None) -> DataFrame:
    """Daily platform cost, its trailing mean (``window`` days incl. the
    current one, at least ``min_periods`` values), the anomaly-window flag,
    the peak day and the idle workspace's average daily cost.  With
    ``rollup`` the daily totals come from the roll-up table."""
    if rollup is not None:
        src, day, cost = rollup, F.col("usage_date"), F.col("cost_usd")
    else:
        src, day, cost = usage, F.to_date("usage_start_time"), F.col("estimated_cost_usd")
    d = src.groupBy(day.alias("usage_date")).agg(
        F.sum(cost).alias("_c"),
        F.sum(F.when(F.col("workspace_id") == idle_workspace, cost)).alias("_z"))
    w = Window.orderBy("usage_date").rowsBetween(-(window - 1), 0)
    n = F.count("_c").over(w)
    lo, hi = spike_window
    return d.select(
        "usage_date",
        money_round("_c").alias("daily_cost"),
        F.when(n >= min_periods, rounded(ratio(F.sum("_c").over(w), n), 2)).alias("rolling_7d_avg"),
        F.col("usage_date").between(date_lit(lo), date_lit(hi)).alias("in_anomaly_window"),
        (F.col("_c") == F.max("_c").over(_all())).alias("is_peak"),
        rounded(ratio(F.sum("_z").over(_all()), F.lit(audit_days)), 2).alias("idle_ws_daily_avg"))


# --------------------------------------------------------------------- D2
def category_spend(usage: DataFrame) -> DataFrame:
    """Spend per chart category, ascending, with percent of total."""
    g = usage.groupBy(chart_category().alias("spend_category")).agg(
        F.sum("estimated_cost_usd").alias("_c"))
    return (g.select("spend_category", money_round("_c").alias("total_cost_usd"),
                     rounded(ratio(F.col("_c").cast("double") * 100, F.sum("_c").over(_all())), 1)
                     .alias("pct_of_total"))
            .orderBy(F.asc_nulls_first("total_cost_usd")))


# --------------------------------------------------------------------- D3
def cost_matrix(usage: DataFrame, rules: Sequence[SavingsRule] = DEFAULT_RULES,
                order: Sequence[str] = MATRIX_ORDER, window_days: int = AUDIT_DAYS) -> DataFrame:
    """Audit-window cost and annual savings per finding, in chart order."""
    pos = F.create_map(*[x for i, code in enumerate(order) for x in (F.lit(code), F.lit(i + 1))])
    return (estimate_savings(usage, rules, window_days)
            .select(pos[F.col("finding")].alias("position"), "finding",
                    F.col("cost_before_90d").alias("cost_90d"),
                    F.col("savings_annual").alias("annual_savings"))
            .orderBy("position"))


# --------------------------------------------------------------------- D4
def gpu_util_vs_cost(usage: DataFrame, labels: Mapping[str, str] = LABELS,
                     sku: str = GPU_CHART_SKU, default_util: float = 50.0,
                     low_below: float = 40.0) -> DataFrame:
    """Per workspace GPU cost vs mean utilisation (missing value counts as
    ``default_util``), position by cost, low-utilisation flag, label and a
    relative bubble size."""
    util = F.coalesce(M.field_of("gpu_utilization_pct").try_cast("double"), F.lit(default_util))
    g = (usage.filter(F.col("sku_name") == sku)
         .select("workspace_id", "estimated_cost_usd", util.alias("_u"))
         .groupBy("workspace_id").agg(F.sum("estimated_cost_usd").alias("_c"),
                                      F.avg("_u").alias("_u")))
    label = F.create_map(*[F.lit(x) for kv in sorted(labels.items()) for x in kv])
    by_cost = Window.orderBy(F.desc_nulls_last("_c"), F.asc("workspace_id"))
    return g.select(
        F.row_number().over(by_cost).alias("position"),
        "workspace_id",
        label[F.col("workspace_id")].alias("label"),
        money_round("_c").alias("total_cost_usd"),
        rounded("_u", 1).alias("avg_gpu_util_pct"),
        (F.col("_u") < low_below).alias("low_utilization"),
        rounded(ratio("_c", F.max("_c").over(_all())) * 900 + 60, 2).alias("bubble_size"))


# --------------------------------------------------------------------- D5
def waterfall(usage: DataFrame, rules: Sequence[SavingsRule] = DEFAULT_RULES,
              window_days: int = AUDIT_DAYS) -> DataFrame:
    """Annualised waste, minus each finding's annual savings, down to the net:
    one bar per step with its base and height (running total)."""
    wr = waste_rules(rules)
    one = _prepared(usage, list(rules) + list(wr)).agg(
        *_masked_sums(rules, "_b"), *_masked_sums(wr, "_w"))
    total = None
    for i, r in enumerate(wr):
        part = F.col(f"_w{i}") * F.lit(Decimal(r.waste_share)).cast("decimal(6,4)")
        total = part if total is None else total + part
    structs = [F.struct(F.lit(0).alias("step"), F.lit("baseline").alias("label"),
                        F.lit("base").alias("kind"),
                        rounded(annualize(total, window_days), 2).alias("delta"))]
    for i, r in enumerate(rules):
        before = F.col(f"_b{i}")
        saved = before - before * F.lit(Decimal(r.retained)).cast("decimal(6,4)")
        structs.append(F.struct(F.lit(i + 1).alias("step"), F.lit(r.code).alias("label"),
                                F.lit("save").alias("kind"),
                                (-rounded(annualize(saved, window_days), 2)).alias("delta")))
    structs.append(F.struct(F.lit(len(rules) + 1).alias("step"), F.lit("net").alias("label"),
                            F.lit("total").alias("kind"), F.lit(None).cast("double").alias("delta")))
    bars = one.select(F.inline(F.array(*structs)))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rounded(F.sum("delta").over(w), 2)
    kind = F.col("kind")
    return bars.select(
        "step", "label", "kind", "delta",
        F.when(kind == "save", running).otherwise(F.lit(0.0)).alias("bottom"),
        F.when(kind == "base", F.col("delta")).when(kind == "save", F.abs("delta"))
        .otherwise(running).alias("height"),
        running.alias("running_total"))


# --------------------------------------------------------------------- P9
def catalog_spend(usage: DataFrame) -> DataFrame:
    """Spend per category of the SKU catalogue (six of them); SKUs that the catalogue does
    not list have no category."""
    return (usage.groupBy("sku_name")
            .agg(F.count(F.lit(1)).alias("_n"), F.sum("usage_quantity").alias("_dbus"),
                 F.sum("estimated_cost_usd").alias("_cost"))
            .groupBy(catalog_category().alias("category"))
            .agg(F.count("sku_name").alias("skus"), F.sum("_n").alias("records"),
                 money_sum("_dbus").alias("total_dbus"), money_sum("_cost").alias("total_cost_usd"))
            .orderBy(F.desc_nulls_last("total_cost_usd"), F.asc_nulls_last("category")))
