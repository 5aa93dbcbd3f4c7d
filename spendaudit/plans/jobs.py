"""Two batch jobs composed from the operators: the daily monitor run and the
full audit report.  They are plain functions (run them from any scheduler);
each result is written as Parquet under ``<out_dir>/<name>/as_of=<date>``
with overwrite, so a re-run of the same day replaces its output.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import audits, compliance, monitors, reports, savings
from ..operators.rollup import refresh_daily_rollup
from ..operators.savings import DEFAULT_RULES, SavingsRule


def _write(outputs: dict[str, DataFrame], out_dir: str, as_of: dt.date) -> dict[str, str]:
    paths = {}
    for name, df in outputs.items():
        path = f"{out_dir.rstrip('/')}/{name}/as_of={as_of.isoformat()}"
        df.write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths


def run_monitors(costed: DataFrame, as_of: dt.date, out_dir: str, *,
                 rollup_path: str | None = None, refresh_days: int = 2) -> dict[str, str]:
    """The daily monitor set for run date ``as_of``: idle sweep of the
    previous day, warehouse spikes of the last 24 h, GPU, weekend and
    pipeline monitors of the last 7 days, the daily alert and the weekly
    attribution.  With ``rollup_path`` the last ``refresh_days`` days of the
    daily roll-up are refreshed as well.  The alert reads the usage itself: a new
    or lapsed roll-up does not hold the baseline it needs."""
    if rollup_path is not None:
        refresh_daily_rollup(costed, rollup_path, lo=as_of - dt.timedelta(days=refresh_days),
                             hi=as_of + dt.timedelta(days=1))
    as_of_ts = dt.datetime.combine(as_of, dt.time())
    outputs = {
        "nightly_idle_sweep": monitors.nightly_idle_sweep(costed, as_of - dt.timedelta(days=1)),
        "warehouse_hourly_spikes": monitors.warehouse_hourly_spikes(costed, as_of_ts),
        "gpu_utilization": monitors.gpu_utilization(costed, as_of),
        "weekend_spend": monitors.weekend_spend(costed, as_of),
        "pipeline_daily": monitors.pipeline_daily(costed, as_of),
        "daily_alert": monitors.daily_alert(costed, as_of),
        "weekly_attribution": monitors.weekly_attribution(costed, as_of),
    }
    return _write(outputs, out_dir, as_of)


def run_audit_report(costed: DataFrame, as_of: dt.date, out_dir: str, *,
                     rules: Sequence[SavingsRule] = DEFAULT_RULES) -> dict[str, str]:
    """The audit report over the usage given (the audit window): the six
    audits, savings estimates with roll-up and waste summary, the report
    datasets and the policy check."""
    outputs = {
        "top_cost_centers": audits.top_cost_centers(costed),
        "sku_breakdown": audits.sku_breakdown(costed),
        "idle_clusters": audits.idle_clusters(costed),
        "compute_efficiency": audits.compute_efficiency(costed),
        "spend_spikes": audits.spend_spikes(costed),
        "pipeline_waste": audits.pipeline_waste(costed),
        "estimate_savings": savings.estimate_savings(costed, rules),
        "savings_rollup": savings.savings_rollup(costed, rules),
        "waste_summary": savings.waste_summary(costed, rules),
        "dataset_profile": savings.dataset_profile(costed),
        "category_spend": reports.category_spend(costed),
        "cost_matrix": reports.cost_matrix(costed, rules),
        "waterfall": reports.waterfall(costed, rules),
        "policy_compliance": compliance.policy_compliance(costed),
    }
    return _write(outputs, out_dir, as_of)
