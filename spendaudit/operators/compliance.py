"""Governance checks posed as table questions: policy compliance, daily
budgets, GPU right-sizing, off-hours candidates and data-quality gates.

The policy and budget tables are small literal dimensions (their size is
fixed by the caller's rule list) and are broadcast; everything that touches
usage rows is a filter, a narrow projection or a partially aggregated
group-by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions.classify import ladder, within
from ..functions.costing import PriceIndex, with_list_cost
from ..functions.money import money_round, money_sum, ratio, rounded
from ..functions.sieve import sieve, sift
from ..schema import (BUDGET_ALERT_PCT, BUDGET_PIPELINE_ID, BUDGET_WAREHOUSE_ID, GPU_INSTANCES, GPU_SKUS, INTERACTIVE_SKUS,
                      NON_PROD_ENVS, PIPELINE_DAILY_DBU_LIMIT, POLICY_RULES,
                      WAREHOUSE_DAILY_DBU_LIMIT, WORKSPACES)
from ..sources.lookups import literal_frame, policy_rules
from .monitors import _days_back, gpu_utilization

SCOPE_SKUS = {"interactive": INTERACTIVE_SKUS, "gpu": GPU_SKUS}


# --------------------------------------------------------------------- R1
def policy_compliance(usage: DataFrame, rules: Sequence[tuple] = POLICY_RULES) -> DataFrame:
    """Usage that ran on configurations violating a compute-policy rule.

    Records are first counted by resource and checked field values; only these groups
    are unpivoted into (field, value) pairs and broadcast-joined to the rule table on
    (scope, field); range, allow-list and fixed-value rules are then evaluated per pair.
    A field that is absent (or not an integer for a range rule) is not evaluable and
    is not reported.  Result: one row per resource, rule and observed value.
    """
    spark: SparkSession = usage.sparkSession
    fields = sorted({r[2] for r in rules})
    scopes = sorted({r[1] for r in rules})
    scope = ladder([(F.col("sku_name").isin(*SCOPE_SKUS[s]), s) for s in scopes], None)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_v_{f}").alias("value"))
                      for f in fields])
    src = (usage.filter(F.col("sku_name").isin(*[k for s in scopes for k in SCOPE_SKUS[s]]))
           .select("workspace_id", "estimated_cost_usd", scope.alias("scope"),
                   M.parsed().alias(M.META_COL))
           .groupBy("workspace_id", "scope",
                    F.coalesce(M.field("cluster_id"), M.field("job_name"),
                               M.field("warehouse_id")).alias("resource_id"),
                    *[M.field(f).alias(f"_v_{f}") for f in fields])
           .agg(F.count(F.lit(1)).alias("_n"), F.sum("estimated_cost_usd").alias("_cost"))
           .select("workspace_id", "scope", "resource_id", "_n", "_cost", F.inline(pairs))
           .filter(F.col("value").isNotNull()))
    rt = F.broadcast(policy_rules(spark, rules))  # the rule list
    v = F.col("value")
    iv = v.try_cast("int")
    kind = F.col("kind")
    violated = (((kind == "range") & ((iv < F.col("min_value")) | (iv > F.col("max_value"))))
                | ((kind == "allowlist") & ~F.array_contains("allowed", v))
                | ((kind == "fixed") & (v != F.element_at("allowed", 1))))
    j = src.join(rt, ["scope", "field"]).filter(violated)
    return (j.groupBy("policy", "field", "kind", "workspace_id", "resource_id",
                      F.col("value").alias("observed_value"))
            .agg(F.sum("_n").alias("violating_records"),
                 money_sum("_cost").alias("violating_cost_usd"))
            .orderBy(F.desc_nulls_last("violating_cost_usd"), "policy", "field", "workspace_id"))


# --------------------------------------------------------------------- R2
def default_budgets(workspace_rows=WORKSPACES, warehouse_id: str = BUDGET_WAREHOUSE_ID,
                    pipeline_id: str = BUDGET_PIPELINE_ID,
                    alert_pct: int = BUDGET_ALERT_PCT) -> list[tuple]:
    """(scope_kind, scope_id, daily_dbu_limit, alert_pct) for every workspace,
    the serverless BI warehouse and the trading pipeline."""
    rows = [("workspace", r[0], r[4], alert_pct) for r in workspace_rows]
    rows.append(("warehouse", warehouse_id, WAREHOUSE_DAILY_DBU_LIMIT, alert_pct))
    rows.append(("pipeline", pipeline_id, PIPELINE_DAILY_DBU_LIMIT, alert_pct))
    return rows


BUDGET_DDL = "scope_kind string, scope_id string, daily_dbu_limit int, alert_pct int"


def budget_status(usage: DataFrame, as_of, days: int = 7,
                  budgets: Sequence[tuple] | DataFrame | None = None) -> DataFrame:
    """Daily DBUs per budgeted scope (workspace, warehouse, pipeline) against
    its limit: OVER_LIMIT above 100 %, ALERT from ``alert_pct``.

    ``budgets`` is a list of (scope_kind, scope_id, daily_dbu_limit,
    alert_pct), which is broadcast, or a DataFrame with those columns, where Spark
    chooses by its size; it is joined to the daily aggregates (never to raw rows)."""
    spark = usage.sparkSession
    if isinstance(budgets, DataFrame):
        bt = budgets.select("scope_kind", "scope_id", "daily_dbu_limit", "alert_pct")
        kinds = ["pipeline", "warehouse", "workspace"]
    else:
        budgets = list(budgets if budgets is not None else default_budgets())
        bt = F.broadcast(literal_frame(spark, budgets, BUDGET_DDL))  # the caller's list
        kinds = sorted({b[0] for b in budgets})
    lo, hi = _days_back(as_of, days)
    key_of = {"workspace": F.col("workspace_id"), "warehouse": M.field("warehouse_id"),
              "pipeline": M.field("pipeline_id")}
    keys = F.array(*[F.struct(F.lit(k).alias("scope_kind"), F.col(f"_{k}").alias("scope_id"))
                     for k in kinds])
    daily = (within(usage, lo=lo, hi=hi)
             .select(F.to_date("usage_start_time").alias("usage_date"), "usage_quantity",
                     "workspace_id", M.parsed().alias(M.META_COL))
             .groupBy("usage_date", *[key_of[k].alias(f"_{k}") for k in kinds])
             .agg(F.sum("usage_quantity").alias("_q"))
             .select("usage_date", "_q", F.inline(keys))
             .filter(F.col("scope_id").isNotNull())
             .groupBy("usage_date", "scope_kind", "scope_id")
             .agg(F.sum("_q").alias("_dbus")))
    pct = ratio(F.col("_dbus").cast("double") * 100, "daily_dbu_limit")
    return (daily.join(bt, ["scope_kind", "scope_id"])
            .select("usage_date", "scope_kind", "scope_id",
                    money_round("_dbus").alias("daily_dbus"), "daily_dbu_limit",
                    rounded(pct, 1).alias("pct_of_limit"),
                    ladder([(pct > 100, "OVER_LIMIT"), (pct >= F.col("alert_pct"), "ALERT")],
                           "OK").alias("status"))
            .orderBy("usage_date", "scope_kind", "scope_id"))


# --------------------------------------------------------------------- R3
def right_size_candidates(usage: DataFrame, as_of, days: int = 7, max_util: float = 50.0,
                          instances: Sequence[tuple] = GPU_INSTANCES) -> DataFrame:
    """GPU jobs under ``max_util`` % busy on an instance dearer than the
    recommended one, with the recommended and fallback (intermediate)
    instance and the cost after moving at the relative price."""
    rel = F.create_map(*[F.lit(x) for r in instances for x in (r[0], r[3])])
    status = F.create_map(*[F.lit(x) for r in instances for x in (r[0], r[4])])
    rec = next(r for r in instances if r[4] == "RECOMMENDED")
    mid = next((r for r in instances if r[4] == "INTERMEDIATE"), rec)
    m = gpu_utilization(usage, as_of, days)
    cur = rel[F.col("instance_type")]
    after = rounded(F.col("total_cost_7d") * F.lit(rec[3]) / cur, 2)
    return (m.filter((F.col("avg_gpu_util_pct") < max_util) & (cur > rec[3]))
            .select("workspace_id", "job_name", "instance_type", "avg_gpu_util_pct",
                    "total_cost_7d", cur.alias("current_relative_cost"),
                    status[F.col("instance_type")].alias("instance_status"),
                    F.lit(rec[0]).alias("recommended_instance"),
                    F.lit(mid[0]).alias("fallback_instance"),
                    after.alias("est_cost_after_7d"),
                    rounded(F.col("total_cost_7d") - after, 2).alias("est_savings_7d"))
            .orderBy(F.desc_nulls_last("est_savings_7d"), "workspace_id", "job_name"))


# --------------------------------------------------------------------- R4
WORKSPACE_DDL = ("workspace_id string, team string, industry string, env string, "
                 "budget_daily_dbu int, label string")


def off_hours_candidates(usage: DataFrame, as_of, days: int = 7,
                         workspace_rows: Sequence[tuple] | DataFrame = WORKSPACES,
                         envs: Sequence[str] = NON_PROD_ENVS,
                         friday_from: int = 18, monday_until: int = 8) -> DataFrame:
    """Interactive clusters of non-production workspaces that ran between
    Friday ``friday_from``:00 and Monday ``monday_until``:00 — what a weekend
    shutdown would stop.

    Off-hours usage is aggregated per cluster first; the workspace dimension
    (rows or a DataFrame with workspace_id, team, env) is joined to those
    aggregates."""
    spark = usage.sparkSession
    if isinstance(workspace_rows, DataFrame):
        ws = workspace_rows.select("workspace_id", "env", "team")
    else:
        ws = F.broadcast(literal_frame(spark, list(workspace_rows), WORKSPACE_DDL)
                         .select("workspace_id", "env", "team"))  # the caller's list
    lo, hi = _days_back(as_of, days)
    ts = F.col("usage_start_time")
    dow, hour = F.dayofweek(ts), F.hour(ts)  # Sunday=1 .. Saturday=7
    off = (((dow == 6) & (hour >= friday_from)) | dow.isin(1, 7)
           | ((dow == 2) & (hour < monday_until)))
    src = (within(usage.filter(F.col("sku_name").isin(*INTERACTIVE_SKUS)), lo=lo, hi=hi)
           .filter(off)
           .select("workspace_id", "estimated_cost_usd", M.parsed().alias(M.META_COL)))
    agg = (src.groupBy("workspace_id", M.field("cluster_id").alias("cluster_id"),
                       M.field("cluster_name").alias("cluster_name"))
           .agg(F.count(F.lit(1)).alias("off_hours_records"),
                money_sum("estimated_cost_usd").alias("off_hours_cost_usd")))
    return (agg.join(ws.filter(F.col("env").isin(*envs)), "workspace_id")
            .select("workspace_id", "env", "team", "cluster_id", "cluster_name",
                    "off_hours_records", "off_hours_cost_usd")
            .orderBy(F.desc_nulls_last("off_hours_cost_usd"), "workspace_id", "cluster_id"))


# --------------------------------------------------------------------- R5
def duplicate_rows(usage: DataFrame, id_col: str = "usage_record_id") -> DataFrame:
    """One-row DataFrame: the number of records whose id occurs more than once.

    Exact, lazy, and cheap to shuffle.  Ids are first grouped by their 64-bit hash (8 bytes
    a row through the shuffle, copies of a hot id combined on the map side).  The hashes
    that occur more than once make a filter of fixed size (``functions.sieve``), which all
    ids probe; no repeated id is missed, and those that pass are counted by the id itself.
    """
    ids = usage.select(F.col(id_col).alias("_id"), F.xxhash64(id_col).alias("_h"))
    repeated = ids.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    per_id = (sift(ids, F.col("_h"), sieve(repeated, "_h"))
              .groupBy("_id").agg(F.count(F.lit(1)).alias("n")))
    return per_id.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
                      .cast("bigint").alias("failing_rows"))


def quality_gates(usage: DataFrame, prices: DataFrame, *,
                  index: PriceIndex | None = None) -> DataFrame:
    """Failing rows per data-quality gate: duplicated record ids, records
    whose end is not start + 1 hour, records without a valid price, and price
    periods overlapping the next period of the same SKU.  ``index`` is the
    prices' index where it is already there."""
    costed = with_list_cost(
        usage.select("sku_name", "usage_start_time", "usage_end_time", "usage_quantity"),
        index or prices)
    bad_duration = (F.col("usage_end_time").isNull()
                    | (F.col("usage_end_time") != F.col("usage_start_time") + F.expr("INTERVAL 1 HOUR")))
    counts = costed.agg(F.count_if(bad_duration).alias("bad"),
                        F.count_if(F.col("estimated_cost_usd").isNull()).alias("unpriced"))
    w = Window.partitionBy("sku_name").orderBy("price_start_time", F.asc_nulls_last("price_end_time"))
    nxt = F.lead("price_start_time").over(w)
    overlaps = (prices.select("sku_name", "price_start_time", "price_end_time",
                              nxt.alias("_next"))
                .filter(F.col("_next").isNotNull()
                        & (F.col("price_end_time").isNull() | (F.col("_next") < F.col("price_end_time"))))
                .agg(F.count(F.lit(1)).cast("bigint").alias("failing_rows")))
    # One-row aggregates become gate rows and are unioned (no join).
    return (duplicate_rows(usage).select(F.lit("duplicate_record_id").alias("gate"), "failing_rows")
            .unionByName(counts.select(F.inline(F.array(
                F.struct(F.lit("end_not_start_plus_1h").alias("gate"),
                         F.col("bad").cast("bigint").alias("failing_rows")),
                F.struct(F.lit("unpriced_record").alias("gate"),
                         F.col("unpriced").cast("bigint").alias("failing_rows"))))))
            .unionByName(overlaps.select(F.lit("overlapping_price_period").alias("gate"),
                                         "failing_rows")))
