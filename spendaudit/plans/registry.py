"""Registered queries: each wires the driver's tables of one scale directory
through the events adapter and the price join into one operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions.costing import with_catalog_cost, with_list_cost
from ..sources.usage_io import (import_usage_csv, number_records, read_usage_parquet,
                                with_record_ids, write_usage_csv)
from ..operators import audits, compliance, monitors, reports, rollup, savings
from ..sources import events_usage as ev
from ..streaming import hourly as stream_hourly
from ..streaming import spikes
from .session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


_COSTED: dict[tuple[str, str], DataFrame] = {}


def _costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costed usage of one scale directory; the (lazy) plan is built once per
    application and shared by every query, as a report job would."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _COSTED:
        _COSTED[key] = ev.fixture_usage(spark, sf_dir)
    return _COSTED[key]


def _audit(fn, **kw) -> Query:
    return lambda spark, sf_dir: fn(_costed(spark, sf_dir), **kw)


def record_costs(df: DataFrame) -> DataFrame:
    """Per-record cost projection (the costing operators' output)."""
    return df.select("usage_record_id", "workspace_id", "sku_name", "usage_start_time",
                     F.col("usage_quantity").cast("double").alias("usage_quantity"),
                     F.col("estimated_cost_usd").cast("double").alias("estimated_cost_usd"))


def _fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/spendaudit-{name}-{uuid.uuid4().hex}"


def _usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored usage fact as a stream, costed by the stream-static price join."""
    stream = stream_hourly.read_usage_stream(spark, ev.usage_table_path(spark, sf_dir), costed=False)
    return with_list_cost(stream, ev.fixture_price_index(spark))


def hourly_cost_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _fresh_folder(spark, "hourly")
    stream_hourly.run_hourly_costs(_usage_stream(spark, sf_dir), folder)
    return stream_hourly.as_hourly_cost_report(stream_hourly.hourly_costs(spark, folder))


def spike_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _fresh_folder(spark, "spikes")
    spikes.run_spike_alerts(
        stream_hourly.hourly_warehouse_cost_stream(_usage_stream(spark, sf_dir)), folder)
    return spikes.spike_alerts(spark, folder)


def deduped_usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries come in two waves, each record's first ones (with copies, one record hot)
    and then more copies of some, most of them later than the watermark; the stream is
    stopped in between."""
    folder = _fresh_folder(spark, "dedup")
    sent = ev.redelivered_usage(spark, sf_dir).drop("usage_date")
    schema = stream_hourly.USAGE_SCHEMA
    for wave in (sent, sent.where("CAST(usage_record_id AS BIGINT) % 7 = 0")):
        wave.write.mode("append").parquet(f"{folder}/deliveries")
        stream_hourly.run_dedup(stream_hourly.read_usage_stream(
            spark, f"{folder}/deliveries", costed=False), folder)
    return stream_hourly.deduped(spark, folder, schema).select(
        "usage_record_id", "workspace_id", "sku_name", "usage_start_time",
        F.col("usage_quantity").cast("double").alias("usage_quantity"))


_ROLLUPS: dict[tuple[str, str], str] = {}


def _rollup(spark: SparkSession, sf_dir: str) -> rollup.DailyRollup:
    """The roll-up of the whole usage fact, built once per application in the shared folder,
    in two refreshes of which the second overlaps the first."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROLLUPS:
        path = _fresh_folder(spark, "rollup")
        split = ev.SPIKE_WINDOW[1]
        rollup.refresh_daily_rollup(_costed(spark, sf_dir), path, hi=split)
        rollup.refresh_daily_rollup(_costed(spark, sf_dir), path, lo=ev.SPIKE_WINDOW[0])
        _ROLLUPS[key] = path
    return rollup.open_rollup(spark, _ROLLUPS[key])


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The costed usage exported as CSV (a third of the JSON documents over several lines)
    and imported again.  The folder also gets bad records for every tenth event, cut off
    after three fields or with a word for the quantity.  Returns each record's fate, with
    the resource named in its document."""
    folder = _fresh_folder(spark, "csv")
    usage = _costed(spark, sf_dir).drop("usage_date")
    event = F.col("usage_record_id").cast("bigint")
    spread = F.when(event % 3 == 0, F.replace("usage_metadata", F.lit(","), F.lit(",\n")))
    write_usage_csv(usage.withColumn("usage_metadata", F.coalesce(spread, "usage_metadata")),
                    f"{folder}/export")
    write_usage_csv(usage.where(event % 20 == 0).select(*usage.columns[:3]),
                    f"{folder}/export", "append")
    write_usage_csv(usage.where(event % 20 == 10).withColumn("usage_quantity", F.lit("many")),
                    f"{folder}/export", "append")
    import_usage_csv(spark, f"{folder}/export", f"{folder}/usage", f"{folder}/quarantine")
    good = read_usage_parquet(spark, f"{folder}/usage")
    resource = F.coalesce(*[F.get_json_object("usage_metadata", f"$.{k}") for k in
                            ("cluster_id", "warehouse_id", "job_name", "pipeline_id")])
    bad = spark.read.schema("record STRING, file STRING").parquet(f"{folder}/quarantine/bad")
    return good.select("usage_record_id", F.lit("good").alias("fate"), "sku_name",
                       F.col("usage_quantity").cast("double").alias("usage_quantity"),
                       F.col("estimated_cost_usd").cast("double").alias("estimated_cost_usd"),
                       resource.alias("resource")
                       ).unionByName(bad.select(F.split("record", ",")[0].alias("usage_record_id"),
                                                F.lit("bad").alias("fate")),
                                     allowMissingColumns=True)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "top_cost_centers": _audit(audits.top_cost_centers),
        "sku_breakdown": _audit(audits.sku_breakdown),
        "cluster_activity": _audit(audits.cluster_activity, window_days=ev.WINDOW_DAYS),
        "idle_clusters": _audit(audits.idle_clusters, window_days=ev.WINDOW_DAYS),
        "idle_clusters_ported": lambda spark, d: audits.idle_clusters_ported(
            ev.usage_table(spark, d), ev.fixture_price_index(spark), ev.AS_OF,
            window_days=ev.WINDOW_DAYS),
        "compute_efficiency": _audit(audits.compute_efficiency),
        "spend_spikes": _audit(audits.spend_spikes),
        "pipeline_waste": _audit(audits.pipeline_waste, window_days=ev.WINDOW_DAYS),
        "nightly_idle_sweep": _audit(monitors.nightly_idle_sweep, day=ev.SWEEP_DAY),
        "warehouse_hourly_spikes": _audit(monitors.warehouse_hourly_spikes, as_of_ts=ev.AS_OF_TS),
        "gpu_utilization": _audit(monitors.gpu_utilization, as_of=ev.AS_OF),
        "weekend_spend": _audit(monitors.weekend_spend, as_of=ev.AS_OF),
        "pipeline_daily": _audit(monitors.pipeline_daily, as_of=ev.AS_OF),
        "daily_alert": _audit(monitors.daily_alert, as_of=ev.AS_OF),
        "weekly_attribution": _audit(monitors.weekly_attribution, as_of=ev.AS_OF),
        "estimate_savings": lambda spark, d: savings.estimate_savings(
            _costed(spark, d), ev.fixture_rules(), window_days=ev.WINDOW_DAYS),
        "savings_rollup": lambda spark, d: savings.savings_rollup(
            _costed(spark, d), ev.fixture_rules(), window_days=ev.WINDOW_DAYS),
        "waste_summary": lambda spark, d: savings.waste_summary(
            _costed(spark, d), ev.fixture_rules(), window_days=ev.WINDOW_DAYS),
        "dataset_profile": _audit(savings.dataset_profile),
        "catalog_cost": lambda spark, d: record_costs(
            with_catalog_cost(ev.usage_table(spark, d))),
        "list_cost": lambda spark, d: record_costs(_costed(spark, d)),
        "daily_burn": _audit(reports.daily_burn, spike_window=ev.SPIKE_WINDOW,
                             idle_workspace=ev.IDLE_WORKSPACE, audit_days=ev.WINDOW_DAYS),
        "category_spend": _audit(reports.category_spend),
        "cost_matrix": lambda spark, d: reports.cost_matrix(
            _costed(spark, d), ev.fixture_rules(), window_days=ev.WINDOW_DAYS),
        "gpu_util_vs_cost": lambda spark, d: reports.gpu_util_vs_cost(
            _costed(spark, d), ev.fixture_labels()),
        "waterfall": lambda spark, d: reports.waterfall(
            _costed(spark, d), ev.fixture_rules(), window_days=ev.WINDOW_DAYS),
        "policy_compliance": _audit(compliance.policy_compliance),
        "budget_status": lambda spark, d: compliance.budget_status(
            _costed(spark, d), ev.AS_OF, budgets=ev.fixture_budgets()),
        "right_size_candidates": _audit(compliance.right_size_candidates, as_of=ev.AS_OF),
        "off_hours_candidates": _audit(compliance.off_hours_candidates, as_of=ev.AS_OF,
                                       workspace_rows=ev.fixture_workspace_rows()),
        "hourly_warehouse_cost": lambda spark, d: stream_hourly.as_hourly_cost_report(
            stream_hourly.hourly_warehouse_cost(_costed(spark, d))),
        "catalog_spend": _audit(reports.catalog_spend),
        "dataset_profile_rollup": lambda spark, d: savings.dataset_profile(rollup=_rollup(spark, d)),
        "cluster_activity_rollup": lambda spark, d: audits.cluster_activity(
            window_days=ev.WINDOW_DAYS, clusters=_rollup(spark, d).clusters),
        "nightly_idle_sweep_rollup": lambda spark, d: monitors.nightly_idle_sweep(
            None, ev.SWEEP_DAY, clusters=_rollup(spark, d).clusters),
        "spend_spikes_rollup": lambda spark, d: audits.spend_spikes(
            rollup=_rollup(spark, d).totals),
        "csv_round_trip": csv_round_trip,
        "hourly_warehouse_cost_stream": hourly_cost_stream,
        "spike_alert_stream": spike_alert_stream,
        "deduped_usage_stream": deduped_usage_stream,
        "record_ids": lambda spark, d: with_record_ids(
            ev.usage_table(spark, d).withColumnRenamed("usage_record_id", "source_id"),
            ignore=("source_id",)).select("source_id", "usage_record_id"),
        "record_sequence": lambda spark, d: number_records(
            ev.redelivered_usage(spark, d)).select(
            "usage_record_id", "usage_start_time", "occurrence", "record_seq"),
        "quality_gates": lambda spark, d: compliance.quality_gates(
            ev.usage_table(spark, d), ev.fixture_prices(spark),
            index=ev.fixture_price_index(spark)),
    }
    return q


def oracle_sql() -> dict[str, str]:
    from . import oracle
    out = {}
    out.update(oracle.audit_sql())
    out.update(oracle.monitor_sql())
    out.update(oracle.savings_sql())
    out.update(oracle.compliance_sql())
    out.update(oracle.streaming_sql())
    out.update(oracle.ids_sql())
    out.update(oracle.table_sql(out))
    return out
