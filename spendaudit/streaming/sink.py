"""Running a stream into a Parquet table, and reading what its state still holds.

A stream's sink has the groups whose watermark has passed; the groups that are still open
are in the state store.  Reading both gives every group exactly once, whether or not more
input ever comes: nobody has to send a far-future record to close the last hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # no log space set aside in advance: it adds up over many state partitions
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def run_available(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Take up all input that is there and append the rows it releases to the Parquet table
    at ``table``, exactly once; a later call with the same folders goes on from there, also
    after a failure half-way.  State is disk-backed (RocksDB), its change logs and the
    table lie in the given folders, which belong on shared storage."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    try:
        for k, v in STATE_SETTINGS.items():
            spark.conf.set(k, v)
        (stream.writeStream.format("parquet").outputMode("append")
         .option("path", table).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_table(spark: SparkSession, table: str, schema) -> DataFrame:
    """The rows that the sink has committed (its log leaves out the files of failed
    attempts); ``schema`` serves a table that has no rows yet."""
    return spark.read.schema(schema).parquet(table)


def operator_id(spark: SparkSession, checkpoint: str, name: str) -> int:
    """Number of the stream's stateful operator of that name (one row per operator)."""
    found = (spark.read.format("state-metadata").load(checkpoint)
             .where(F.col("operatorName") == name).select("operatorId").distinct().collect())
    if len(found) != 1:
        raise ValueError(f"{len(found)} operators {name} in {checkpoint}")
    return found[0][0]


def open_groups(spark: SparkSession, checkpoint: str, key: str, value: str) -> DataFrame:
    """Groups of the stream's watermarked aggregation that it has not released yet, as one
    struct ``key`` and one struct ``value`` of aggregation buffers.  Fields are named by
    the given DDL types, by place."""
    operator = operator_id(spark, checkpoint, "stateStoreSave")
    return (spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
            .select(F.col("key").cast(key).alias("key"), F.col("value").cast(value).alias("value")))
