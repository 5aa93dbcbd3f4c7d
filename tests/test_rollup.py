"""The daily roll-up path gives the same answers as aggregating usage."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from spendaudit.operators import audits, monitors, reports
from spendaudit.operators import savings
from spendaudit.operators.rollup import (IncompleteRollup, complete_rollup, daily_totals, ledger,
                                         open_rollup, read_daily_rollup, refresh_daily_rollup,
                                         rollup_gaps, stale_days)
from spendaudit.sources import events_usage as ev


def same(a, b):
    return a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()


def test_rollup_answers_equal_direct(spark, tmp_path):
    u = ev.fixture_usage(spark, SF_ORACLE)
    path = str(tmp_path / "rollup")
    refresh_daily_rollup(u, path)
    r = read_daily_rollup(spark, path)
    assert same(audits.spend_spikes(u), audits.spend_spikes(rollup=r))
    assert same(monitors.daily_alert(u, ev.AS_OF), monitors.daily_alert(None, ev.AS_OF, rollup=r))
    kw = dict(spike_window=ev.SPIKE_WINDOW, idle_workspace=ev.IDLE_WORKSPACE)
    assert same(reports.daily_burn(u, **kw), reports.daily_burn(rollup=r, **kw))


def test_incremental_refresh_replaces_only_recomputed_days(spark, tmp_path):
    u = ev.fixture_usage(spark, SF_ORACLE)
    path = str(tmp_path / "rollup")
    refresh_daily_rollup(u, path, hi=dt.date(2024, 1, 20))       # first load
    refresh_daily_rollup(u, path, lo=dt.date(2024, 1, 15))       # later refresh, overlapping
    assert same(read_daily_rollup(spark, path), daily_totals(u))


D = dt.date


def days(u, lo, hi):
    return u.where((F.to_date("usage_start_time") >= F.lit(lo)) & (F.to_date("usage_start_time") < F.lit(hi)))


def test_days_that_lost_their_usage_lose_their_rows(spark, tmp_path):
    u, path = ev.fixture_usage(spark, SF_ORACLE), str(tmp_path / "rollup")
    refresh_daily_rollup(u, path)
    kept = u.where(F.to_date("usage_start_time") != F.lit(D(2024, 1, 12)))
    refresh_daily_rollup(kept, path, lo=D(2024, 1, 10), hi=D(2024, 1, 14))
    assert same(read_daily_rollup(spark, path), daily_totals(kept))
    entry = ledger(spark, path).where(F.col("usage_date") == F.lit(D(2024, 1, 12))).first()
    assert (entry.record_count, entry.version) == (0, 2)
    assert same(savings.dataset_profile(rollup=open_rollup(spark, path)), savings.dataset_profile(kept))


def test_gaps_are_refused_found_and_filled(spark, tmp_path):
    u, path = ev.fixture_usage(spark, SF_ORACLE).drop("usage_date"), str(tmp_path / "rollup")
    refresh_daily_rollup(u, path, lo=D(2024, 1, 1), hi=D(2024, 1, 5))
    refresh_daily_rollup(u, path, lo=D(2024, 1, 8), hi=dt.datetime(2024, 1, 20, 12))
    gap = [D(2024, 1, 5), D(2024, 1, 6), D(2024, 1, 7)]
    assert rollup_gaps(spark, path) == gap
    with pytest.raises(IncompleteRollup) as e:
        read_daily_rollup(spark, path)
    assert e.value.missing == gap
    with pytest.raises(IncompleteRollup):  # asked for more days than were ever refreshed
        read_daily_rollup(spark, path, lo=D(2024, 1, 8), hi=D(2024, 1, 25))
    assert same(read_daily_rollup(spark, path, lo=D(2024, 1, 8), hi=D(2024, 1, 21)),
                daily_totals(days(u, D(2024, 1, 8), D(2024, 1, 21))))
    late = u.limit(3).withColumn("usage_start_time", F.lit("2024-01-02 05:00:00").cast("timestamp"))
    more = u.unionByName(late)
    wrong = {r.usage_date: (r.in_usage, r.in_rollup)
             for r in stale_days(more, path, D(2024, 1, 1), D(2024, 1, 21)).collect()}
    assert set(wrong) == {D(2024, 1, 2), *gap} and wrong[gap[0]][1] is None
    assert wrong[D(2024, 1, 2)][0] == wrong[D(2024, 1, 2)][1] + 3
    assert complete_rollup(more, path, D(2024, 1, 1), D(2024, 1, 21)) == [D(2024, 1, 2), *gap]
    assert same(read_daily_rollup(spark, path), daily_totals(days(more, D(2024, 1, 1), D(2024, 1, 21))))


def test_a_refresh_that_fails_half_way_changes_nothing(spark, tmp_path):
    u, path = ev.fixture_usage(spark, SF_ORACLE), str(tmp_path / "rollup")
    refresh_daily_rollup(u, path)
    before = read_daily_rollup(spark, path).count()
    # a later version's totals are there, its ledger is not
    (daily_totals(u.limit(50)).write.partitionBy("usage_date").parquet(f"{path}/totals/version=2"))
    assert read_daily_rollup(spark, path).count() == before
    refresh_daily_rollup(u, path, lo=D(2024, 1, 3), hi=D(2024, 1, 4))
    assert same(read_daily_rollup(spark, path), daily_totals(u))


def test_distinct_skus_of_windows_and_new_skus(spark, tmp_path):
    u, path = ev.fixture_usage(spark, SF_ORACLE), str(tmp_path / "rollup")
    odd = u.limit(5).withColumn("sku_name", F.concat(F.lit("NEW_"), "usage_record_id"))
    odd = odd.withColumn("usage_start_time", F.lit("2024-01-20 01:00:00").cast("timestamp"))
    all_ = u.unionByName(odd).unionByName(odd.withColumn("sku_name", F.lit(None).cast("string")))
    refresh_daily_rollup(all_, path, hi=D(2024, 1, 10))
    refresh_daily_rollup(all_, path, lo=D(2024, 1, 10))
    for lo, hi in ((None, None), (D(2024, 1, 3), D(2024, 1, 4)), (D(2024, 1, 19), D(2024, 1, 22))):
        part = days(all_, lo, hi) if lo else all_
        assert same(savings.dataset_profile(rollup=open_rollup(spark, path, lo, hi)),
                    savings.dataset_profile(part))


def test_cluster_moments_merge_over_windows(spark, tmp_path):
    u, path = ev.fixture_usage(spark, SF_ORACLE), str(tmp_path / "rollup")
    one = u.where("sku_name LIKE '%ALL_PURPOSE%'").limit(1)  # a lone hour: no deviation
    lone = one.withColumn("usage_metadata", F.lit('{"cluster_id": "lone"}'))
    u = u.unionByName(lone).unionByName(lone.withColumn("usage_quantity", F.lit(None).cast("decimal(18,4)"))
                                        .withColumn("usage_metadata", F.lit('{"cluster_id": "none"}')))
    refresh_daily_rollup(u, path)
    r = open_rollup(spark, path).clusters
    assert same(audits.cluster_activity(clusters=r), audits.cluster_activity(u))
    assert same(audits.idle_clusters(clusters=r), audits.idle_clusters(u))
    for d in (3, 17):
        assert same(monitors.nightly_idle_sweep(None, D(2024, 1, d), clusters=r),
                    monitors.nightly_idle_sweep(u, D(2024, 1, d)))


def test_an_empty_rollup(spark, tmp_path):
    u, path = ev.fixture_usage(spark, SF_ORACLE).limit(0), str(tmp_path / "rollup")
    assert read_daily_rollup(spark, path).collect() == [] and rollup_gaps(spark, path) == []
    refresh_daily_rollup(u, path)
    assert same(savings.dataset_profile(rollup=open_rollup(spark, path)), savings.dataset_profile(u))
