"""Savings estimators, their roll-up, the waste summary and the data profile.

Every finding is a mask over usage rows plus the share of the masked cost a
fix would retain.  All masks are evaluated in ONE pass as conditional sums of
a single global aggregate (partial on the map side, one row per task), then
unpivoted with ``inline`` into one row per finding; no per-finding scan,
no join.  Sums are exact decimals; outputs are rounded doubles.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions.classify import ts_lit
from ..functions.money import annualize, money_round, ratio, rounded
from ..schema import AUDIT_DAYS
from .rollup import DailyRollup


@dataclasses.dataclass(frozen=True)
class SavingsRule:
    """One finding: rows of ``workspaces`` x ``skus`` (optionally within
    ``[start, end)``, on weekends only, or with a non-empty pipeline id);
    ``retained`` is the share of their cost left after the fix and
    ``waste_share`` the share the waste summary counts as recoverable."""
    code: str
    workspaces: tuple[str, ...]
    skus: tuple[str, ...]
    retained: str
    waste_share: str = "1"
    start: dt.date | None = None
    end: dt.date | None = None
    weekend_only: bool = False
    require_pipeline: bool = False
    clusters: tuple[str, ...] = ()  # optional: only these cluster ids (metadata)

    def mask(self) -> Column:
        m = F.col("workspace_id").isin(*self.workspaces) & F.col("sku_name").isin(*self.skus)
        if self.start is not None:
            m = m & (F.col("usage_start_time") >= ts_lit(self.start))
        if self.end is not None:
            m = m & (F.col("usage_start_time") < ts_lit(self.end))
        if self.weekend_only:
            m = m & (F.weekday(F.col("usage_start_time")) >= 5)
        if self.require_pipeline:
            m = m & F.col("_pipeline_id").isNotNull() & (F.col("_pipeline_id") != "")
        if self.clusters:
            m = m & F.col("_cluster_id").isin(*self.clusters)
        return m


# FIXED VALUES — the five findings of the audited estate (90-day window).
DEFAULT_RULES: tuple[SavingsRule, ...] = (
    SavingsRule("idle_cluster", ("ws-zombie-008",), ("PREMIUM_ALL_PURPOSE_COMPUTE",), "0.05"),
    SavingsRule("sql_spike", ("ws-prod-bi-004",), ("SERVERLESS_SQL_COMPUTE",), "0.15",
                start=dt.date(2026, 2, 10), end=dt.date(2026, 2, 13)),
    SavingsRule("gpu_overprovisioning", ("ws-retail-forecast-002",), ("GPU_SERVERLESS_COMPUTE",),
                "0.50", waste_share="0.50"),
    SavingsRule("weekend_dev", ("ws-sandbox-ds-005", "ws-health-analytics-003"),
                ("STANDARD_ALL_PURPOSE_COMPUTE",), "0.05", weekend_only=True),
    SavingsRule("continuous_pipeline", ("ws-fsi-trading-001",), ("JOBS_SERVERLESS_COMPUTE",),
                "0.40", waste_share="0.60", require_pipeline=True),
)
NET_RECOVERY = "0.97"  # share of annualised waste the automated policies recover
EXTRAPOLATE_TO = (50, 100)  # estate sizes for the linear extrapolation


def waste_rules(rules: Sequence[SavingsRule]) -> tuple[SavingsRule, ...]:
    """The waste summary counts all pipeline-SKU spend of the workspace (no
    pipeline-id filter)."""
    return tuple(dataclasses.replace(r, require_pipeline=False) for r in rules)


def _prepared(usage: DataFrame, rules: Sequence[SavingsRule]) -> DataFrame:
    """The columns the masks read.  Metadata fields (pipeline id, cluster id)
    are parsed from the JSON document only for rows in the scope of a rule
    that needs them (CASE evaluates its branch lazily), not for every record."""
    cols = ["workspace_id", "sku_name", "usage_start_time", "estimated_cost_usd"]
    extra = []
    for name, needs in (("pipeline_id", lambda r: r.require_pipeline),
                        ("cluster_id", lambda r: bool(r.clusters))):
        scope = None
        for r in rules:
            if needs(r):
                c = F.col("workspace_id").isin(*r.workspaces) & F.col("sku_name").isin(*r.skus)
                scope = c if scope is None else scope | c
        if scope is not None:
            extra.append(F.when(scope, M.field_of(name)).alias(f"_{name}"))
    return usage.select(*cols, *extra)


def _masked_sums(rules: Sequence[SavingsRule], prefix: str) -> list[Column]:
    cost = F.col("estimated_cost_usd")
    return [F.coalesce(F.sum(F.when(r.mask(), cost)), F.lit(0)).cast("decimal(38,4)")
            .alias(f"{prefix}{i}") for i, r in enumerate(rules)]


def _totals() -> list[Column]:
    return [F.coalesce(F.sum("estimated_cost_usd"), F.lit(0)).cast("decimal(38,4)").alias("_total"),
            F.count_distinct("workspace_id").alias("_n_ws")]


def _finding_rows(rules: Sequence[SavingsRule], prefix: str = "_b") -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(r.code).alias("finding"),
                 F.lit(" + ".join(r.workspaces)).alias("workspace"),
                 F.col(f"{prefix}{i}").alias("_before"),
                 F.lit(Decimal(r.retained)).cast("decimal(6,4)").alias("_retained"))
        for i, r in enumerate(rules)]))


def _savings_projection(window_days: int) -> list[Column]:
    before = F.col("_before")
    after = before * F.col("_retained")
    return [F.col("position"), F.col("finding"), F.col("workspace"),
            money_round(before).alias("cost_before_90d"),
            money_round(after).alias("cost_after_90d"),
            money_round(before - after).alias("savings_90d"),
            rounded(annualize(before - after, window_days), 2).alias("savings_annual"),
            F.col("_retained").cast("double").alias("retained_share")]


def estimate_savings(usage: DataFrame, rules: Sequence[SavingsRule] = DEFAULT_RULES,
                     window_days: int = AUDIT_DAYS) -> DataFrame:
    """One row per finding: cost before/after the fix, 90-day and annual savings."""
    one = _prepared(usage, rules).agg(*_masked_sums(rules, "_b"))
    return one.select(_finding_rows(rules)).select(*_savings_projection(window_days))


def savings_rollup(usage: DataFrame, rules: Sequence[SavingsRule] = DEFAULT_RULES,
                   window_days: int = AUDIT_DAYS,
                   extrapolate_to: Sequence[int] = EXTRAPOLATE_TO) -> DataFrame:
    """Totals over the (rounded) finding rows, savings rate, share of all
    platform spend and a per-workspace linear extrapolation."""
    one = _prepared(usage, rules).agg(*_masked_sums(rules, "_b"), *_totals())
    rows = one.select(_finding_rows(rules), "_total", "_n_ws").select(
        *_savings_projection(window_days), "_total", "_n_ws")
    g = rows.agg(
        rounded(F.sum("cost_before_90d"), 2).alias("total_cost_before_90d"),
        rounded(F.sum("cost_after_90d"), 2).alias("total_cost_after_90d"),
        rounded(F.sum("savings_90d"), 2).alias("total_savings_90d"),
        rounded(F.sum("savings_annual"), 2).alias("total_savings_annual"),
        F.max("_total").alias("_total"), F.max("_n_ws").alias("workspaces_audited"))
    per_ws = ratio("total_savings_annual", "workspaces_audited")
    return g.select(
        "total_cost_before_90d", "total_cost_after_90d", "total_savings_90d",
        "total_savings_annual",
        rounded(ratio("total_savings_90d", "total_cost_before_90d") * 100, 1).alias("savings_rate_pct"),
        rounded(ratio("total_savings_90d", "_total") * 100, 1).alias("pct_of_platform_spend"),
        "workspaces_audited",
        rounded(per_ws, 2).alias("annual_savings_per_workspace"),
        *[rounded(per_ws * n, 2).alias(f"annual_savings_{n}_workspaces") for n in extrapolate_to])


def waste_summary(usage: DataFrame, rules: Sequence[SavingsRule] = DEFAULT_RULES,
                  window_days: int = AUDIT_DAYS, net_recovery: str = NET_RECOVERY) -> DataFrame:
    """Recoverable waste per finding (masked cost x waste share), its total,
    annualised and net projections and its share of spend; one row."""
    wr = waste_rules(rules)
    one = _prepared(usage, wr).agg(*_masked_sums(wr, "_w"), *_totals())
    parts = [F.col(f"_w{i}") * F.lit(Decimal(r.waste_share)).cast("decimal(6,4)")
             for i, r in enumerate(wr)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    annual = annualize(total, window_days)
    return one.select(
        *[money_round(p).alias(f"{r.code}_waste_usd") for p, r in zip(parts, wr)],
        money_round(total).alias("total_waste_90d"),
        rounded(annual, 2).alias("annual_waste"),
        rounded(annual * float(net_recovery), 2).alias("net_annual_savings"),
        rounded(ratio(total, "_total") * 100, 1).alias("pct_of_total_spend"))


def dataset_profile(usage: DataFrame | None = None, *, rollup: DailyRollup | None = None
                    ) -> DataFrame:
    """Row count, date range, totals and distinct workspaces / SKUs, from one row per
    (workspace, SKU): the distinct counts expand those, not the records.  With ``rollup``
    they come from days x workspaces rows, distinct SKUs by an OR of bitmaps."""
    if rollup is not None:
        sets = rollup.sku_bits.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("_bits"))
        skus = sets.select(F.coalesce(F.sum(F.bitmap_count("_bits")), F.lit(0).cast("bigint")))
        return rollup.totals.agg(
            F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_records"),
            F.min("usage_date").alias("first_date"), F.max("usage_date").alias("last_date"),
            money_round(F.sum("dbus")).alias("total_dbus"),
            money_round(F.sum("cost_usd")).alias("total_cost_usd"),
            F.count_distinct("workspace_id").alias("unique_workspaces"),
        ).withColumn("unique_skus", skus.scalar())
    day = F.to_date("usage_start_time")
    groups = usage.groupBy("workspace_id", "sku_name").agg(
        F.count(F.lit(1)).alias("_n"), F.min(day).alias("_first"), F.max(day).alias("_last"),
        F.sum("usage_quantity").alias("_dbus"), F.sum("estimated_cost_usd").alias("_cost"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_records"),
        F.min("_first").alias("first_date"),
        F.max("_last").alias("last_date"),
        money_round(F.sum("_dbus")).alias("total_dbus"),
        money_round(F.sum("_cost")).alias("total_cost_usd"),
        F.count_distinct("workspace_id").alias("unique_workspaces"),
        F.count_distinct("sku_name").alias("unique_skus"))
