"""Structured Streaming forms of the hourly warehouse monitor.

* ``hourly_warehouse_cost_stream`` (T1): event-time hourly warehouse cost
  with a watermark, emitted once per closed hour (append mode).
* T2, spike alerts on these hours, is in ``spikes``.
* ``dedup_records`` (T3): drops re-delivered usage records by id within the
  watermark (state is bounded by the watermark, not by the stream's length);
  ``dedup_records_combining`` is the form that pre-aggregates copies before
  the shuffle, for sources where one record may be re-delivered en masse.

``run_hourly_costs`` and ``run_dedup`` run T1 and T3 into Parquet tables; ``hourly_costs``
and ``deduped`` read them back together with what the streams' state still holds.

Sources are file streams of usage records (``readStream.schema(...)``), so
the same code runs on Parquet drops or any other streaming source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import meta as M
from ..schema import COSTED_USAGE_SCHEMA, SQL_SKUS, USAGE_SCHEMA
from .sink import open_groups, read_table, run_available


def read_usage_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None, costed: bool = True,
                      **options) -> DataFrame:
    """File stream of usage records with the fixed schema (with or without
    the cost column); extra keyword arguments are source options."""
    r = spark.readStream.schema(COSTED_USAGE_SCHEMA if costed else USAGE_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


DEDUP_KEYS = ("usage_record_id", "usage_start_time")


def dedup_records(stream: DataFrame, watermark: str = "24 hours") -> DataFrame:
    """T3: at-most-once per ``usage_record_id`` within the watermark."""
    return (stream.withWatermark("usage_start_time", watermark)
            .dropDuplicatesWithinWatermark(["usage_record_id"]))


def dedup_records_combining(stream: DataFrame, watermark: str = "24 hours") -> DataFrame:
    """T3, skew-safe form: a watermarked aggregation keyed by (record id,
    start time) that keeps one copy (the smallest row, so the choice is
    deterministic).  Copies of a record are collapsed by the map-side
    partial aggregation before the shuffle, so even a re-delivery storm of
    one record does not land in one task; each record is emitted once the
    watermark passes its start time (append mode)."""
    rest = [c for c in stream.columns if c not in DEDUP_KEYS]
    return (stream.withWatermark("usage_start_time", watermark)
            .groupBy(*DEDUP_KEYS)
            .agg(F.min(F.struct(*rest)).alias("_row"))
            .select(*DEDUP_KEYS, "_row.*")
            .select(*stream.columns))


def hourly_warehouse_cost(usage: DataFrame) -> DataFrame:
    """Hourly SQL-warehouse cost per (hour, workspace, warehouse).  Works on a
    batch or a streaming DataFrame (a tumbling event-time window)."""
    src = (usage.filter(F.col("sku_name").isin(*SQL_SKUS))
           .select("workspace_id", "usage_start_time", "estimated_cost_usd",
                   M.parsed().alias(M.META_COL)))
    return (src.groupBy(F.window("usage_start_time", "1 hour").alias("w"), "workspace_id",
                        M.field("warehouse_id").alias("warehouse_id"),
                        M.field("warehouse_name").alias("warehouse_name"))
            .agg(F.sum("estimated_cost_usd").alias("_hc"),
                 F.sum(M.long_field("query_count_hourly")).alias("total_queries"),
                 F.count(F.lit(1)).alias("records"))
            .select(F.col("w.start").alias("hour_bucket"), "workspace_id", "warehouse_id",
                    "warehouse_name", "_hc", "total_queries", "records"))


def hourly_warehouse_cost_stream(stream: DataFrame, watermark: str = "24 hours") -> DataFrame:
    """T1: hourly warehouse cost of a usage stream; with append output each
    hour is emitted once the watermark has passed its end."""
    return hourly_warehouse_cost(stream.withWatermark("usage_start_time", watermark))


def as_hourly_cost_report(hourly: DataFrame) -> DataFrame:
    """Public columns of the hourly aggregate (cost as double)."""
    return hourly.select("hour_bucket", "workspace_id", "warehouse_id", "warehouse_name",
                         F.col("_hc").cast("double").alias("hourly_cost"), "total_queries",
                         "records")


HOURLY_SCHEMA = ("hour_bucket timestamp, workspace_id string, warehouse_id string, "
                 "warehouse_name string, _hc decimal(28,4), total_queries long, records long")


def open_hours(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The hourly rows that a stream of ``hourly_warehouse_cost_stream`` has not released
    yet, from its state."""
    groups = open_groups(
        spark, checkpoint,
        "struct<w: struct<start: timestamp, end: timestamp>, ws: string, id: string, name: string>",
        "struct<cost: decimal(28,4), no_cost: boolean, queries: bigint, records: bigint>")
    return groups.select(
        F.col("key.w.start").alias("hour_bucket"), F.col("key.ws").alias("workspace_id"),
        F.col("key.id").alias("warehouse_id"), F.col("key.name").alias("warehouse_name"),
        F.when(~F.col("value.no_cost"), F.col("value.cost")).alias("_hc"),
        F.col("value.queries").alias("total_queries"), F.col("value.records").alias("records"))


def run_hourly_costs(usage: DataFrame, folder: str, watermark: str = "24 hours") -> None:
    """T1 as a job: take up all costed usage that the stream has now; hours that the
    watermark has passed are appended to ``<folder>/closed``, open ones stay in the state
    at ``<folder>/state``.  Run it again with the same folder when more usage has come."""
    run_available(hourly_warehouse_cost_stream(usage, watermark), f"{folder}/closed",
                  f"{folder}/state")


def hourly_costs(spark: SparkSession, folder: str, *, flush: bool = True) -> DataFrame:
    """Hourly rows as of the last run: the released hours and, with ``flush``, what the
    open ones have come to so far."""
    closed = read_table(spark, f"{folder}/closed", HOURLY_SCHEMA)
    return closed.unionByName(open_hours(spark, f"{folder}/state")) if flush else closed


def run_dedup(stream: DataFrame, folder: str, watermark: str = "24 hours") -> None:
    """T3 as a job: deliveries to a table with one row per record (``dedup_records_combining``).
    Records are appended to ``<folder>/closed`` once the watermark has passed their start;
    copies that come even later are dropped as late."""
    run_available(dedup_records_combining(stream, watermark), f"{folder}/closed",
                  f"{folder}/state")


def deduped(spark: SparkSession, folder: str, schema: T.StructType, *, flush: bool = True
            ) -> DataFrame:
    """One row per record as of the last run; ``schema`` is the stream's."""
    closed = read_table(spark, f"{folder}/closed", schema)
    if not flush:
        return closed
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    rest = ", ".join(f"`{c}`: {t}" for c, t in types.items() if c not in DEDUP_KEYS)
    groups = open_groups(spark, f"{folder}/state",
                         f"struct<{', '.join(f'{c}: {types[c]}' for c in DEDUP_KEYS)}>",
                         f"struct<row: struct<{rest}>>")
    return closed.unionByName(groups.select("key.*", "value.row.*"))
