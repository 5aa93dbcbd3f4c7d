"""Streaming operators equal their batch counterparts (T1-T3)."""

import datetime as dt
import random
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendaudit.operators.monitors import hourly_spikes, warehouse_hourly
from spendaudit.sources import events_usage as ev
from spendaudit.streaming import hourly as S
from spendaudit.streaming import spikes

SENTINEL_TS = "2030-01-01 00:00:00"


@pytest.fixture(scope="module")
def drops(spark, tmp_path_factory):
    """Costed usage of sf0.01 written as one Parquet file per day, plus a
    final file with one far-future record that pushes the watermark past
    every real hour."""
    base = tmp_path_factory.mktemp("drops")
    u = ev.fixture_usage(spark, "/root/testdata/sf0.01").drop("usage_date")
    days = sorted(r[0] for r in u.select(F.to_date("usage_start_time")).distinct().collect())
    for i, d in enumerate(days):
        (u.filter(F.to_date("usage_start_time") == F.lit(d)).coalesce(1)
         .write.parquet(str(base / "in" / f"{i:03d}")))
    sentinel = (u.limit(1).withColumn("usage_record_id", F.lit("sentinel"))
                .withColumn("workspace_id", F.lit("ws-sentinel"))
                .withColumn("sku_name", F.lit("SQL_PRO_COMPUTE"))
                .withColumn("usage_start_time", F.lit(SENTINEL_TS).cast("timestamp")))
    sentinel.coalesce(1).write.parquet(str(base / "in" / "999"))
    return base, u


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _run(query):
    query.processAllAvailable()
    query.awaitTermination(120)
    query.stop()


def _stream(spark, base):
    return S.read_usage_stream(spark, str(base / "in"), max_files_per_trigger=5,
                               recursiveFileLookup="true")


def test_t1_hourly_stream_equals_batch(spark, drops):
    base, u = drops
    out = S.hourly_warehouse_cost_stream(_stream(spark, base), watermark="1 hour")
    q = (S.as_hourly_cost_report(out).writeStream.outputMode("append").format("parquet")
         .option("path", str(base / "t1"))
         .option("checkpointLocation", str(base / "t1_ckpt"))
         .trigger(availableNow=True).start())
    _run(q)
    got = spark.read.parquet(str(base / "t1")).filter(F.col("workspace_id") != "ws-sentinel")
    want = S.as_hourly_cost_report(S.hourly_warehouse_cost(u))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def _day_files(base):
    return sorted((base / "in").glob("0*/*.parquet"))


def test_t1_flush_has_every_hour_after_a_restart_without_a_sentinel(spark, drops, tmp_path):
    """Days arrive in two runs of the same stream; no later record closes the last hours."""
    base, u = drops
    files = _day_files(base)
    for part in (files[:12], files[12:]):
        for f in part:
            (tmp_path / "in" / f.parent.name).mkdir(parents=True)
            shutil.copy(f, tmp_path / "in" / f.parent.name)
        S.run_hourly_costs(_stream(spark, tmp_path), str(tmp_path / "t1"), "24 hours")
    closed = S.hourly_costs(spark, str(tmp_path / "t1"), flush=False)
    whole = S.hourly_costs(spark, str(tmp_path / "t1"))
    want = S.hourly_warehouse_cost(u)
    last = u.agg(F.max("usage_start_time")).first()[0] - dt.timedelta(hours=24)
    assert same(whole, want)
    assert same(closed.where(F.col("hour_bucket") < last - dt.timedelta(hours=1)),
                want.where(F.col("hour_bucket") < last - dt.timedelta(hours=1)))
    assert 0 < closed.count() < want.count()


def test_t2_state_alerts_equal_batch_after_a_restart(spark, drops, tmp_path):
    base, u = drops
    files = _day_files(base)
    for part in (files[:9], files[9:20], files[20:]):
        for f in part:
            (tmp_path / "in" / f.parent.name).mkdir(parents=True)
            shutil.copy(f, tmp_path / "in" / f.parent.name)
        hourly = S.hourly_warehouse_cost_stream(_stream(spark, tmp_path), "24 hours")
        spikes.run_spike_alerts(hourly, str(tmp_path / "t2"))
    got, want = spikes.spike_alerts(spark, str(tmp_path / "t2")), hourly_spikes(warehouse_hourly(u))
    assert want.count() > 0 and same(got, want)
    # a run without new input judges nothing anew
    judged = spark.read.parquet(str(tmp_path / "t2" / "judged")).count()
    spikes.run_spike_alerts(S.hourly_warehouse_cost_stream(_stream(spark, tmp_path), "24 hours"),
                            str(tmp_path / "t2"))
    assert spark.read.parquet(str(tmp_path / "t2" / "judged")).count() == judged


def _final(judged):
    last = {}
    for j in judged:
        last[j[:3]] = max(last.get(j[:3], j), j, key=lambda x: x[5])
    return {k: j[6] for k, j in last.items()}


def test_t2_late_rows_are_put_in_place():
    """Any order of arrival, in any batches, ends with the baselines of the sorted rows."""
    rng = random.Random(3)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), w, None if h % 5 == 0 else "n",
             None if h % 7 == 0 else Decimal(rng.randrange(1, 9999)) / 100, 1, 0)
            for h in range(20) for w in ("a", None)]
    order = sorted(rows, key=spikes._place)
    want = {}
    for i, r in enumerate(order):
        known = [x[3] for x in order[max(0, i - 4):i] if x[3] is not None]
        want[r[:3]] = float(sum(known)) / len(known) if known else None
    for _ in range(20):
        left, kept, judged = rng.sample(rows, len(rows)), [], []
        while left:
            n = rng.randrange(1, 9)
            kept, out = spikes.judge(kept, left[:n] + left[:1], 4, 1000, False)
            judged += out
            left = left[n:]
        assert _final(judged) == want
    # rows that are no longer kept cannot be judged; nothing else changes
    kept, _ = spikes.judge([], order, 4, 8, False)
    assert len(kept) == 8 and spikes.judge(kept, order[:1], 4, 8, True) == (kept, [])


def test_t3_dedup_within_watermark(spark, drops, tmp_path):
    base, u = drops
    # deliver every record of the first three days twice, in separate files
    src = tmp_path / "dup"
    first = u.filter(F.col("usage_start_time") < F.lit("2024-01-04").cast("timestamp"))
    first.coalesce(1).write.parquet(str(src / "a"))
    first.coalesce(1).write.parquet(str(src / "b"))
    stream = (spark.readStream.schema(S.COSTED_USAGE_SCHEMA).option("maxFilesPerTrigger", 5)
              .option("recursiveFileLookup", "true").parquet(str(src)))
    q = (S.dedup_records(stream).writeStream.format("parquet").outputMode("append")
         .option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    _run(q)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == first.count() == out.select("usage_record_id").distinct().count()


def test_t3_job_drops_late_copies_and_flushes_open_records(spark, drops, tmp_path):
    base, u = drops
    raw = u.select(*[c for c in u.columns if c != "estimated_cost_usd"])
    hot = raw.limit(1).withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("_c")
    early = raw.where("usage_start_time < '2024-01-05'")
    for wave in (raw.unionByName(hot), early.unionByName(raw.where("usage_start_time > '2024-01-29'"))):
        wave.write.mode("append").parquet(str(tmp_path / "in"))
        S.run_dedup(S.read_usage_stream(spark, str(tmp_path / "in"), costed=False),
                    str(tmp_path / "t3"))
    got = S.deduped(spark, str(tmp_path / "t3"), S.USAGE_SCHEMA)
    assert same(got, raw)
    assert 0 < S.deduped(spark, str(tmp_path / "t3"), S.USAGE_SCHEMA, flush=False).count() < raw.count()


def test_t3_combining_dedup_collapses_hot_copies(spark, drops, tmp_path):
    base, u = drops
    src = tmp_path / "dup"
    first = u.filter(F.col("usage_start_time") < F.lit("2024-01-04").cast("timestamp"))
    hot = first.limit(1)
    for i in range(3):  # three deliveries of the data, the hot record 20 more times
        first.coalesce(1).write.parquet(str(src / f"a{i}"))
    (hot.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("_copy")
     .coalesce(1).write.parquet(str(src / "hot")))
    spark.read.parquet(str(base / "in" / "999")).write.parquet(str(src / "z_sentinel"))
    stream = (spark.readStream.schema(S.COSTED_USAGE_SCHEMA).option("maxFilesPerTrigger", 2)
              .option("recursiveFileLookup", "true").parquet(str(src)))
    q = (S.dedup_records_combining(stream, watermark="1 hour").writeStream.format("parquet")
         .outputMode("append").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    _run(q)
    out = spark.read.parquet(str(tmp_path / "out")).filter(F.col("usage_record_id") != "sentinel")
    assert out.count() == first.count() == out.select("usage_record_id").distinct().count()
    assert out.exceptAll(first.select(*out.columns)).count() == 0


def test_t1_costs_a_raw_stream_with_the_price_join(spark, drops, tmp_path):
    """Production streams carry no cost: the list-price validity join runs as
    a stream-static broadcast join inside the streaming query."""
    from spendaudit.functions.costing import with_list_cost
    base, u = drops
    raw = S.read_usage_stream(spark, str(base / "in"), max_files_per_trigger=10, costed=False,
                              recursiveFileLookup="true")
    costed = with_list_cost(raw, ev.fixture_prices(spark))
    out = S.hourly_warehouse_cost_stream(costed, watermark="1 hour")
    q = (S.as_hourly_cost_report(out).writeStream.outputMode("append").format("parquet")
         .option("path", str(tmp_path / "t1raw"))
         .option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    _run(q)
    got = spark.read.parquet(str(tmp_path / "t1raw")).filter(F.col("workspace_id") != "ws-sentinel")
    want = S.as_hourly_cost_report(S.hourly_warehouse_cost(u))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0
