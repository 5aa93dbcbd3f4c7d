"""Adapter from the driver's ``events`` table to a usage fact.

The test tables carry no billing data, so usage is derived from ``events`` as
a deterministic, row-for-row projection (no shuffle, no generator): every
event becomes one hourly usage record.  With ``w = user_id % 8`` and
``k = props.k`` (0..99):

* workspace ``ws-00{w+1}``; record id ``event_id``; start ``ts``, end ``ts + 1h``
* idle cluster when ``w = 7 and k < 60`` (premium interactive, flat quantity,
  auto-termination 0, no job); continuous pipeline when ``w = 0 and k < 40``
  (serverless jobs, idle when ``k < 25``); otherwise SKU ``k % 12`` of the
  catalogue
* quantity ``value / 10`` (exact decimal), metadata JSON by SKU family

The workspaces ``ws-001`` .. ``ws-008`` play the roles of the audited estate's
eight workspaces in catalogue order, which is how the dimension tables and
savings rules below are derived.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MONEY, SKU_CATALOG, WORKSPACES
from .lookups import literal_frame
from ..functions.costing import PriceIndex, price_index
from .usage_io import (PARTITIONED_USAGE_SCHEMA, read_price_index, read_usage_parquet,
                       write_price_index, write_table_once, write_usage)

SKUS = [s for s, _r, _c in SKU_CATALOG]

# Parameters that make the relative-time monitors reproducible on the events
# window (2024-01-01 .. 2024-01-30).
AS_OF = dt.date(2024, 1, 31)
AS_OF_TS = dt.datetime(2024, 1, 31, 0, 0, 0)
WINDOW_DAYS = 30  # days that the events cover: base of the annual projections
SWEEP_DAY = dt.date(2024, 1, 30)
SPIKE_WINDOW = (dt.date(2024, 1, 10), dt.date(2024, 1, 13))
PRICE_CHANGE = "2024-01-15 00:00:00"


_SKU_ARRAY = "array(" + ", ".join(f"'{s}'" for s in SKUS) + ")"

# Metadata document per SKU family (first match wins).
_META = """CASE
  WHEN idle THEN to_json(named_struct(
    'cluster_id', 'idle-1', 'cluster_name', 'legacy', 'job_id', CAST(NULL AS STRING),
    'autotermination_minutes', 0, 'data_security_mode', 'NONE'))
  WHEN pipe THEN to_json(named_struct(
    'pipeline_id', 'p-1', 'pipeline_name', 'b2s', 'pipeline_mode', 'CONTINUOUS',
    'trigger_interval', CAST(NULL AS STRING), 'target_table', 's.t', 'job_id', 'dlt-1',
    'data_processed_gb', IF(k < 25, 0.0D, 4.5D)))
  WHEN sku_name IN ('SQL_PRO_COMPUTE', 'SERVERLESS_SQL_COMPUTE') THEN to_json(named_struct(
    'warehouse_id', concat('wh-', w), 'warehouse_name', concat('n-', k % 3),
    'query_count_hourly', k))
  WHEN sku_name IN ('GPU_SERVERLESS_COMPUTE', 'FOUNDATION_MODEL_TRAINING') THEN to_json(named_struct(
    'job_id', concat('ml-', k), 'job_name', concat('train-', w % 3),
    'instance_type', IF(w % 2 = 0, 'p4d.24xlarge', 'g5.xlarge'), 'gpu_type', 'A',
    'gpu_utilization_pct', CAST(k AS DOUBLE) + 0.5D))
  ELSE to_json(named_struct(
    'cluster_id', concat('c-', w), 'cluster_name', concat('cl-', w),
    'job_id', IF(k % 2 = 0, CAST(NULL AS STRING), concat('j-', k)),
    'autotermination_minutes', 60, 'data_security_mode', 'USER_ISOLATION'))
END"""


def usage_from_events(events: DataFrame) -> DataFrame:
    base = events.selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS ts", "CAST(user_id % 8 AS INT) AS w",
        "TRY_CAST(get_json_object(props, '$.k') AS INT) AS k", "value")
    keyed = base.selectExpr(
        "*", "w = 7 AND k < 60 AS idle", "w = 0 AND k < 40 AS pipe",
        f"""CASE WHEN w = 7 AND k < 60 THEN 'PREMIUM_ALL_PURPOSE_COMPUTE'
                 WHEN w = 0 AND k < 40 THEN 'JOBS_SERVERLESS_COMPUTE'
                 ELSE try_element_at({_SKU_ARRAY}, k % 12 + 1) END AS sku_name""")
    return keyed.selectExpr(
        "CAST(event_id AS STRING) AS usage_record_id",
        "concat('ws-', lpad(CAST(w + 1 AS STRING), 3, '0')) AS workspace_id",
        "sku_name",
        "ts AS usage_start_time",
        "ts + INTERVAL 1 HOUR AS usage_end_time",
        f"""CAST(IF(idle, 4.00BD + CAST(k % 5 AS DECIMAL(10,0)) * 0.02BD,
                    CAST(value AS DECIMAL(18,2)) * 0.1BD) AS {MONEY.simpleString()})
            AS usage_quantity""",
        f"{_META} AS usage_metadata")


EVENTS_SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
                 "value DOUBLE, props STRING")
ADAPTER_VERSION = "3"


def read_events_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage projection of ``events`` (computed on every read)."""
    return usage_from_events(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


_TABLES: dict[tuple[str, str], DataFrame] = {}


def source_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, size, modification time) of the files of a table, listed through the file
    system that Spark reads it with."""
    conf = spark._jsc.hadoopConfiguration()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    found = fs.listFiles(at, True) if fs.getFileStatus(at).isDirectory() else None
    out = []
    while found is not None and found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    if found is None:
        f = fs.getFileStatus(at)
        out = [(f.getPath().toString(), f.getLen(), f.getModificationTime())]
    return sorted(out)


def usage_table_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the usage fact derived from ``events``, stored the way production
    stores it: Parquet partitioned by ``usage_date``, written once into the
    session's shared checkpoint folder (keyed by the source files' paths,
    sizes and modification times and the session time zone)."""
    import hashlib
    from ..plans.session import ensure_checkpoint_dir
    src = f"{sf_dir}/events.parquet"
    tz = spark.conf.get("spark.sql.session.timeZone")  # the NTZ -> TIMESTAMP cast depends on it
    key = hashlib.sha1(
        f"{src}|{source_files(spark, src)}|{tz}|{ADAPTER_VERSION}".encode()).hexdigest()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/spendaudit-usage/{key[:16]}"
    return write_table_once(spark, lambda: read_events_usage(spark, sf_dir), path, write_usage)


def usage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored usage fact, read with an explicit schema.  The table is immutable once
    written, so the DataFrame (and its file listing) is reused within the application."""
    memo = (spark.sparkContext.applicationId, usage_table_path(spark, sf_dir))
    if memo not in _TABLES:
        _TABLES[memo] = read_usage_parquet(spark, memo[1], PARTITIONED_USAGE_SCHEMA)
    return _TABLES[memo]


def redelivered_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage fact as a source that delivers at least once would send it: records of
    every seventh event arrive twice, those of every 49th five times, and the records of
    event 0 a third as often as there are events (one hot record)."""
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    n = events.select((F.count(F.lit(1)) / 3).cast("int")).scalar()
    usage = usage_table(spark, sf_dir)
    event = F.col("usage_record_id").cast("bigint")
    copies = (F.when(event == 0, n).when(event % 49 == 0, 5).when(event % 7 == 0, 2).otherwise(1))
    return (usage.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy"))


def fixture_prices(spark: SparkSession) -> DataFrame:
    """Catalogue rates valid from 2023 and open-ended, except: the premium
    interactive SKU costs 0.50 before 2024-01-15 and 0.55 after; the catalog
    SKU is deliberately unpriced."""
    rows = []
    for sku, rate, _cat in SKU_CATALOG:
        if sku == "UNITY_CATALOG_COMPUTE":
            continue
        if sku == "PREMIUM_ALL_PURPOSE_COMPUTE":
            rows.append((sku, "0.50", "2023-01-01 00:00:00", PRICE_CHANGE))
            rows.append((sku, rate, PRICE_CHANGE, None))
        else:
            rows.append((sku, rate, "2023-01-01 00:00:00", None))
    df = literal_frame(spark, rows, "sku_name string, rate string, s string, e string")
    return df.select(
        F.col("sku_name"),
        F.struct(F.col("rate").cast("decimal(10,4)").alias("default")).alias("pricing"),
        F.col("s").cast("timestamp").alias("price_start_time"),
        F.col("e").cast("timestamp").alias("price_end_time"))


_INDEXES: dict[str, PriceIndex] = {}


def fixture_price_index(spark: SparkSession) -> PriceIndex:
    """The index of ``fixture_prices``, written once per application to the shared folder."""
    from ..plans.session import ensure_checkpoint_dir
    app = spark.sparkContext.applicationId
    if app not in _INDEXES:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/spendaudit-prices/{app}"
        write_price_index(price_index(fixture_prices(spark)), path, mode="overwrite")
        _INDEXES[app] = read_price_index(spark, path)
    return _INDEXES[app]


def fixture_workspace_id(n: int) -> str:
    return "ws-%03d" % n


def fixture_workspace_rows():
    """The estate's workspace attributes keyed by ordinal test ids."""
    return [(fixture_workspace_id(i),) + tuple(r[1:]) for i, r in enumerate(WORKSPACES, 1)]


def fixture_labels() -> dict[str, str]:
    return {fixture_workspace_id(i): r[5] for i, r in enumerate(WORKSPACES, 1)}


def fixture_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costed usage of an sf directory (list-price validity join)."""
    from ..functions.costing import with_list_cost
    return with_list_cost(usage_table(spark, sf_dir), fixture_price_index(spark))


def fixture_rules():
    """The estate's savings rules with workspaces renamed to their ordinal
    test ids and the spike window moved into the events window."""
    import dataclasses
    from ..operators.savings import DEFAULT_RULES
    ids = {r[0]: fixture_workspace_id(i) for i, r in enumerate(WORKSPACES, 1)}
    out = []
    for r in DEFAULT_RULES:
        kw = {"workspaces": tuple(ids[w] for w in r.workspaces)}
        if r.start is not None:
            kw.update(start=SPIKE_WINDOW[0], end=SPIKE_WINDOW[1])
        out.append(dataclasses.replace(r, **kw))
    return tuple(out)


IDLE_WORKSPACE = fixture_workspace_id(8)


def fixture_budgets():
    """Daily DBU budgets: each test workspace's estate budget, the BI
    workspace's warehouse (``wh-3``) and the continuous pipeline (``p-1``)."""
    from ..operators.compliance import default_budgets
    return default_budgets(fixture_workspace_rows(), warehouse_id="wh-3", pipeline_id="p-1")
