"""Session construction and shared-storage helpers.

Production sessions are created by the cluster; ``tune`` only sets the SQL
options the audits rely on (UTC, AQE with skew handling).  ``local_session``
is for tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.enableJsonExpressionOptimization": "true",
}
# Driver-side only: skip PySpark's per-call origin capture (several JVM round
# trips per DataFrame function) in batch jobs and the benchmark.
PY_DEFAULTS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def local_session(cpus: int | None = None, app: str = "spendaudit",
                  shuffle_partitions: int | None = None) -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("SPENDAUDIT_DRIVER_MEMORY", "8g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus)))
    for k, v in {**SQL_DEFAULTS, **PY_DEFAULTS}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return d or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's checkpoint folder; only when none is configured and the
    session is local (as in tests) create a private one under the temp directory.
    On a cluster the executors would not see such a folder: that is an error."""
    d = checkpoint_dir(spark)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all "
                               f"executors share (master {master})")
        d = tempfile.mkdtemp(prefix="spendaudit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder
    (survives executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cluster_settings(total_cores: int) -> dict[str, str]:
    """SQL options for a large cluster, derived from its total core count.

    * ~2 shuffle partitions per core; AQE then coalesces the (small)
      post-aggregation stages and splits skewed join partitions.
    * 256 MB scan splits: large sequential Parquet reads; the aggregations
      reduce rows by orders of magnitude before any shuffle.
    * Broadcasts stay explicit (size-checked in code), so the automatic
      threshold is kept modest.
    """
    return {
        **SQL_DEFAULTS,
        "spark.sql.shuffle.partitions": str(max(200, 2 * total_cores)),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    }


def tune(spark: SparkSession, total_cores: int) -> SparkSession:
    """Apply ``cluster_settings`` to a running session (all are runtime SQL options)."""
    for k, v in cluster_settings(total_cores).items():
        spark.conf.set(k, v)
    return spark
