"""Exact deduplication over keyed streaming state.

Documents arrive as a stream of narrow records (digest, identifier, content
locator).  A Structured Streaming aggregation on RocksDB keeps, per digest and
without expiry, the number of arrivals and the best (identifier, locator); the state
is disk-backed and checkpointed in the shared folder, and it never holds a text.
The decisions are read from that state with Spark's state reader.  Where a digest was
hit more than once, the full bytes of its members are compared; texts that only share
the digest are told apart.

Everything runs on DataFrame operations; no Python code runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (FILE, ROW, cut, join_groups, keep_rows, land_at, shared_path, total_rows,
                     whole_text, with_locator)

PREFIXES = 1 << 20     # hash values that members are sifted by before texts are compared
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # no log space set aside in advance: it adds up over many state partitions
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _best() -> Column:
    return F.max(F.struct("id", FILE, ROW))


def stream_state(arrivals: DataFrame, checkpoint: str) -> None:
    """Feed a stream of arrivals (digest, id, locator) through the keyed state kept
    at ``checkpoint``; a later call with the same folder continues it."""
    spark = arrivals.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        (arrivals.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best().alias("keep"))
         .writeStream.format("noop").outputMode("update")
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark, checkpoint: str) -> DataFrame:
    """(digest, n, keep) as the state store holds them."""
    return (spark.read.format("statestore").load(checkpoint)
            .select(F.col("key.digest").alias("digest"), F.col("value.count").alias("n"),
                    F.col("value.max").alias("keep")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          digest: Callable[[Column], Column] = sha256,
          batch_bytes: int = 256 << 20) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, locator.

    Of equal texts (NULL is the empty text, nothing else is changed) the row with the
    largest id stays; a NULL id ranks lowest, and among rows repeating the same id the
    one with the largest locator stays.  Repeated rows are listed one by one.  An
    empty table gives an empty result.  ``batch_bytes`` bounds the arrivals taken up
    per micro-batch.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    members = with_locator(docs).select(
        F.col(id_col).alias("id"), FILE, ROW, text.alias("text"), sha256(text).alias("sha"),
        digest(text).alias("digest"))
    arrivals, path = land_at(members.drop("text"), "arrivals")
    if arrivals.isEmpty():
        return _decisions(arrivals.withColumn("n", F.lit(0).cast("long"))
                          .withColumn("keep", F.struct("id", FILE, ROW)), id_col)
    checkpoint = shared_path(spark, "dedup-state")
    stream_state(spark.readStream.schema(arrivals.schema)
                 .option("maxBytesPerTrigger", batch_bytes).parquet(path), checkpoint)
    state = cut(read_state(spark, checkpoint))
    total = total_rows(state, "n")

    collided = _collided(members, state, total)
    decided = join_groups(arrivals, state, "digest", "n", total)
    if not collided.isEmpty():
        apart = members.join(collided, "digest", "left_semi")
        classes = apart.groupBy("digest", "text").agg(
            F.count(F.lit(1)).alias("n"), _best().alias("keep"))
        decided = (decided.join(collided, "digest", "left_anti")
                   .unionByName(apart.join(classes, ["digest", "text"]).drop("text")))
    return _decisions(decided, id_col)


def _collided(members: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """Digests whose members are not all the same bytes.

    Only digests hit more than once are compared.  Members are first sifted by a hash
    of the digest, against the at most PREFIXES values that hits have, so that few other
    texts are moved.  Heavy digests collapse to one row per distinct text in each map
    task: a huge group of copies costs no more than a small one.
    """
    hits = state.where("n > 1").select("digest", "n")
    sieve = F.pmod(F.xxhash64("digest"), F.lit(PREFIXES)).cast("int").alias("sieve")
    sifted = members.select("digest", "text", sieve).join(
        F.broadcast(hits.select(sieve).distinct()), "sieve", "left_semi").drop("sieve")
    hit_members = join_groups(sifted, hits, "digest", "n", total, how="left_semi")
    return cut(hit_members.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
               .where("texts > 1").select("digest"))


def _decisions(decided: DataFrame, id_col: str) -> DataFrame:
    kept = (F.col(FILE) == F.col("keep")[FILE]) & (F.col(ROW) == F.col("keep")[ROW])
    return decided.select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"),
        FILE, ROW)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies; all columns are kept as they are."""
    located = with_locator(docs)
    return keep_rows(located, dedup(located, id_col, text_col).where("kept"))
