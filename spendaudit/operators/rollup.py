"""Daily roll-up of the usage fact, with a ledger of what it covers.

Three tables of mergeable, exact daily aggregates, from which the daily and windowed
operators get the answers that the usage itself would give:

* ``totals``: per (day, workspace) cost, DBUs, records, distinct SKUs (spend spikes, daily
  alert, burn chart);
* ``sku_bits``: per (day, workspace) the set of SKUs as bitmaps over a small dictionary of
  SKU ids, so that distinct SKUs of any window are one OR over days x workspaces rows;
* ``clusters``: per (day, interactive cluster configuration) the count, exact sum and exact
  sum of squares of the hourly quantities, so that mean, deviation and flatness of any
  window come from days x clusters rows.

A refresh recomputes whole days.  It writes them under a new version and then, as its last
step, lists every day of its range in the ledger, days without usage too.  Readers take of
each day the version that the ledger names last: a refresh that fails half-way changes
nothing, a day that lost its usage loses its rows, and a day that no refresh ever covered
is known to be missing.  One refresh runs at a time.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions.classify import date_lit, within
from ..plans.session import materialize
from ..schema import INTERACTIVE_SKUS

ROLLUP_SCHEMA = ("usage_date DATE, workspace_id STRING, cost_usd DECIMAL(28,4), "
                 "dbus DECIMAL(28,4), sku_count BIGINT, record_count BIGINT")
SKU_BITS_SCHEMA = "usage_date DATE, workspace_id STRING, bucket BIGINT, bits BINARY"
CLUSTER_KEYS = ("workspace_id", "cluster_id", "cluster_name", "job_id", "autotermination_min",
                "data_security_mode")
CLUSTER_SCHEMA = ("usage_date DATE, workspace_id STRING, cluster_id STRING, cluster_name STRING, "
                  "job_id STRING, autotermination_min INT, data_security_mode STRING, "
                  "hours BIGINT, q_count BIGINT, q_sum DECIMAL(28,4), q_squares DECIMAL(38,8), "
                  "cost_usd DECIMAL(28,4)")
LEDGER_SCHEMA = "usage_date DATE, record_count BIGINT, version INT"
_SCHEMAS = {"totals": ROLLUP_SCHEMA, "sku_bits": SKU_BITS_SCHEMA, "clusters": CLUSTER_SCHEMA}


class IncompleteRollup(ValueError):
    """The roll-up lacks days that were asked for."""

    def __init__(self, missing: list[dt.date]):
        super().__init__(f"{len(missing)} days are not in the roll-up, the first on {missing[0]}")
        self.missing = missing


@dataclass(frozen=True)
class DailyRollup:
    """The current rows of a roll-up's tables over a range of days."""
    totals: DataFrame
    sku_bits: DataFrame
    clusters: DataFrame


# ---------------------------------------------------------------- aggregates
def daily_totals(usage: DataFrame) -> DataFrame:
    """Per (usage_date, workspace_id): exact cost and DBU sums, distinct SKUs
    and records (partial aggregation first, so a hot workspace costs one
    partial row per task)."""
    return usage.groupBy(F.to_date("usage_start_time").alias("usage_date"), "workspace_id").agg(
        F.sum("estimated_cost_usd").cast("decimal(28,4)").alias("cost_usd"),
        F.sum("usage_quantity").cast("decimal(28,4)").alias("dbus"),
        F.count_distinct("sku_name").alias("sku_count"),
        F.count(F.lit(1)).alias("record_count"))


def cluster_days(usage: DataFrame) -> DataFrame:
    """Per day and interactive cluster configuration: hours, and the moments of the hourly
    quantity as exact sums."""
    q = F.col("usage_quantity").cast("decimal(18,4)")
    src = (usage.filter(F.col("sku_name").isin(*INTERACTIVE_SKUS))
           .select(F.to_date("usage_start_time").alias("usage_date"), "workspace_id",
                   q.alias("_q"), "estimated_cost_usd", M.parsed().alias(M.META_COL)))
    return src.groupBy(
        "usage_date", "workspace_id",
        *[M.field(c).alias(c) for c in ("cluster_id", "cluster_name", "job_id")],
        M.int_field("autotermination_minutes").alias("autotermination_min"),
        M.field("data_security_mode").alias("data_security_mode"),
    ).agg(F.count(F.lit(1)).alias("hours"), F.count("_q").alias("q_count"),
          F.sum("_q").cast("decimal(28,4)").alias("q_sum"),
          F.sum(F.col("_q") * F.col("_q")).cast("decimal(38,8)").alias("q_squares"),
          F.sum("estimated_cost_usd").cast("decimal(28,4)").alias("cost_usd"))


def moments_stddev(n: str, total: str, squares: str):
    """Sample standard deviation from a count, a sum and a sum of squares.  Their
    difference is taken in exact decimals, so nothing cancels; NULL below two values.
    A total quantity of 10^14 or more does not fit and raises an overflow error."""
    count = F.col(n).cast("decimal(10,0)")
    total_ = F.col(total).cast("decimal(18,4)")
    spread = (count * F.col(squares).cast("decimal(27,8)") - total_ * total_).cast("double")
    pairs = F.col(n).cast("double") * (F.col(n) - 1)
    return F.when(F.col(n) > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / pairs))


# ------------------------------------------------------------------- ledger
def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema + (", version INT" if "version" not in schema else "")
                                 ).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema + (", version INT" if "version" not in schema else ""))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(usage_date, record_count, version): the state of every day that was refreshed."""
    rows = _read(spark, f"{path}/ledger", LEDGER_SCHEMA)
    return (rows.groupBy("usage_date").agg(F.max(F.struct("version", "record_count")).alias("_last"))
            .select("usage_date", "_last.record_count", "_last.version"))


def _days(lo: dt.date, hi: dt.date) -> list[dt.date]:
    return [lo + dt.timedelta(days=i) for i in range((hi - lo).days)]


def _whole_days(lo, hi) -> tuple[dt.date | None, dt.date | None]:
    """The range of whole days that covers ``[lo, hi)``."""
    if isinstance(hi, dt.datetime):
        hi = hi.date() + dt.timedelta(days=hi.time() > dt.time())
    return lo.date() if isinstance(lo, dt.datetime) else lo, hi


def rollup_gaps(spark: SparkSession, path: str, lo=None, hi=None) -> list[dt.date]:
    """Days of ``[lo, hi)`` (by default from the first to the last day in the ledger) that no
    refresh has covered.  The list is bounded by the days of the range."""
    lo, hi = _whole_days(lo, hi)
    known = {r[0] for r in ledger(spark, path).select("usage_date").collect()} - {None}
    if not known and (lo is None or hi is None):
        return []
    lo = lo or min(known)
    hi = hi or max(known) + dt.timedelta(days=1)
    return [d for d in _days(lo, hi) if d not in known]


def stale_days(usage: DataFrame, path: str, lo=None, hi=None) -> DataFrame:
    """(usage_date, in_usage, in_rollup): days whose usage has another number of records now
    than when they were last refreshed, days that were never refreshed among them."""
    lo, hi = _whole_days(lo, hi)
    now = (within(usage, lo=lo, hi=hi).groupBy(F.to_date("usage_start_time").alias("usage_date"))
           .agg(F.count(F.lit(1)).alias("in_usage")))
    then = ledger(usage.sparkSession, path).select("usage_date", F.col("record_count").alias("in_rollup"))
    for bound, keep in ((lo, F.col("usage_date") >= date_lit(lo) if lo else None),
                        (hi, F.col("usage_date") < date_lit(hi) if hi else None)):
        then = then.where(keep) if bound else then
    return (now.join(then.withColumnRenamed("usage_date", "_day"),
                     F.col("usage_date").eqNullSafe(F.col("_day")), "full")
            .select(F.coalesce("usage_date", "_day").alias("usage_date"),
                    F.coalesce("in_usage", F.lit(0)).alias("in_usage"), "in_rollup")
            .where("in_rollup IS NULL OR in_usage <> in_rollup"))


# ------------------------------------------------------------------ refresh
def refresh_daily_rollup(usage: DataFrame, path: str, lo=None, hi=None) -> int:
    """Recompute the whole days of ``[lo, hi)`` and return the new version.

    Without ``lo`` or ``hi`` the range ends at the usage's own first or last day.  Days of
    the range without usage are listed as empty, and rows that they had are no longer read.
    """
    spark = usage.sparkSession
    lo, hi = _whole_days(lo, hi)
    src = within(usage, lo=lo, hi=hi)
    version = 1 + (_read(spark, f"{path}/ledger", LEDGER_SCHEMA).agg(F.max("version")).first()[0] or 0)

    def write(rows: DataFrame, table: str) -> None:
        (rows.write.mode("overwrite").partitionBy("usage_date")
         .parquet(f"{path}/{table}/version={version}"))

    # one scan serves totals and SKU sets: days x workspaces x SKUs rows
    parts = materialize(src.groupBy(F.to_date("usage_start_time").alias("usage_date"),
                                    "workspace_id", "sku_name")
                        .agg(F.sum("estimated_cost_usd").alias("_cost"),
                             F.sum("usage_quantity").alias("_dbus"), F.count(F.lit(1)).alias("_n")))
    write(parts.groupBy("usage_date", "workspace_id").agg(
        F.sum("_cost").cast("decimal(28,4)").alias("cost_usd"),
        F.sum("_dbus").cast("decimal(28,4)").alias("dbus"),
        F.count("sku_name").alias("sku_count"), F.sum("_n").alias("record_count")), "totals")
    ids = _sku_ids(parts, path, version)
    write(parts.join(ids, "sku_name")
          .groupBy("usage_date", "workspace_id", F.call_function("bitmap_bucket_number", "sku_id")
                   .alias("bucket"))
          .agg(F.bitmap_construct_agg(F.bitmap_bit_position("sku_id")).alias("bits")), "sku_bits")
    write(cluster_days(src), "clusters")

    days = parts.groupBy("usage_date").agg(F.sum("_n").alias("record_count"))
    span = days.agg(F.min("usage_date"), F.max("usage_date")).first()
    first, last = lo or span[0], (hi - dt.timedelta(days=1)) if hi else span[1]
    if first is not None and last is not None and first <= last:
        every = spark.range(1).select(F.explode(F.sequence(date_lit(first), date_lit(last)))
                                      .alias("usage_date"))
        days = (every.join(days, "usage_date", "full")
                .select("usage_date", F.coalesce("record_count", F.lit(0).cast("bigint"))
                        .alias("record_count")))
    (days.select("usage_date", "record_count")  # days of the range: one small file
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/version={version}"))
    return version


def _sku_ids(parts: DataFrame, path: str, version: int) -> DataFrame:
    """(sku_name, sku_id) with the SKUs that are new numbered on from the last id."""
    spark = parts.sparkSession
    known = _read(spark, f"{path}/sku_ids", "sku_name STRING, sku_id BIGINT").drop("version")
    last = known.agg(F.max("sku_id")).first()[0]
    new = parts.select("sku_name").where("sku_name IS NOT NULL").distinct().join(
        known, "sku_name", "left_anti")
    # SKUs of the catalogue: a dimension
    numbered = new.select("sku_name", (F.row_number().over(Window.orderBy("sku_name"))
                                       + F.lit(-1 if last is None else last)).cast("bigint")
                          .alias("sku_id"))
    numbered.write.mode("overwrite").parquet(f"{path}/sku_ids/version={version}")
    return _read(spark, f"{path}/sku_ids", "sku_name STRING, sku_id BIGINT").drop("version")


def complete_rollup(usage: DataFrame, path: str, lo=None, hi=None) -> list[dt.date]:
    """Refresh the days of ``[lo, hi)`` that are missing or stale, and return them."""
    lo, hi = _whole_days(lo, hi)
    wrong = {r[0] for r in stale_days(usage, path, lo, hi).select("usage_date").collect()} - {None}
    wrong |= set(rollup_gaps(usage.sparkSession, path, lo, hi))
    todo = sorted(wrong)  # days
    while todo:
        n = next((i for i in range(1, len(todo)) if (todo[i] - todo[0]).days != i), len(todo))
        refresh_daily_rollup(usage, path, todo[0], todo[n - 1] + dt.timedelta(days=1))
        todo = todo[n:]
    return sorted(wrong)


# ------------------------------------------------------------------ reading
def open_rollup(spark: SparkSession, path: str, lo=None, hi=None, *, check: bool = True
                ) -> DailyRollup:
    """The roll-up of the days in ``[lo, hi)``.  With ``check``, days that it lacks raise
    ``IncompleteRollup`` (``complete_rollup`` fills them in); otherwise a short table would
    give sums that are too small without anyone noticing."""
    lo, hi = _whole_days(lo, hi)
    if check:
        missing = rollup_gaps(spark, path, lo, hi)
        if missing:
            raise IncompleteRollup(missing)
    days = ledger(spark, path).select(F.col("usage_date").alias("_day"), F.col("version").alias("_v"))
    if lo:
        days = days.where(F.col("_day") >= date_lit(lo))
    if hi:
        days = days.where(F.col("_day") < date_lit(hi))

    def current(table: str) -> DataFrame:
        rows = _read(spark, f"{path}/{table}", _SCHEMAS[table])
        keep = F.col("usage_date").eqNullSafe(F.col("_day")) & (F.col("version") == F.col("_v"))
        # a row per day: small whatever the usage
        return rows.join(F.broadcast(days), keep, "left_semi").drop("version")

    return DailyRollup(*[current(t) for t in ("totals", "sku_bits", "clusters")])


def read_daily_rollup(spark: SparkSession, path: str, lo=None, hi=None, *, check: bool = True
                      ) -> DataFrame:
    """The (day, workspace) totals of ``open_rollup``."""
    return open_rollup(spark, path, lo, hi, check=check).totals
