"""Hand-written edge rows (FIXTURES §5): NULL handling, boundaries, ties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendaudit.functions.classify import is_weekend
from spendaudit.functions.costing import with_catalog_cost, with_list_cost
from spendaudit.operators import audits, compliance, monitors

STD, PREM = "STANDARD_ALL_PURPOSE_COMPUTE", "PREMIUM_ALL_PURPOSE_COMPUTE"
JOBS_SL = "JOBS_SERVERLESS_COMPUTE"


def hours(start: str, n: int):
    t0 = dt.datetime.fromisoformat(start)
    return [(t0 + dt.timedelta(hours=i)).strftime("%Y-%m-%d %H:%M:%S") for i in range(n)]


def test_single_record_group_has_null_spread(make_usage):
    u = make_usage([("1", "ws", STD, "2024-01-01 00:00:00", "2.0",
                     {"cluster_id": "c", "autotermination_minutes": 60}, "0.8")])
    a = audits.cluster_activity(u).collect()[0]
    assert a.total_hours_active == 1
    assert a.stddev_hourly_dbu is None and a.usage_cv_pct is None
    assert audits.idle_clusters(u).count() == 0


def test_zero_mean_gives_null_cv_without_error(make_usage):
    u = make_usage([(str(i), "ws", STD, t, "0", {"cluster_id": "c"}, "0")
                    for i, t in enumerate(hours("2024-01-01 00:00:00", 3))])
    a = audits.cluster_activity(u).collect()[0]
    assert a.avg_hourly_dbu == 0.0 and a.stddev_hourly_dbu == 0.0 and a.usage_cv_pct is None


def test_json_null_missing_and_null_document_all_read_as_null(make_usage):
    sku = "JOBS_COMPUTE"
    u = make_usage([
        ("1", "ws", sku, "2024-01-01 00:00:00", "10", {"job_id": None}, "20"),
        ("2", "ws", sku, "2024-01-01 01:00:00", "10", {"other": 1}, "20"),
        ("3", "ws", sku, "2024-01-01 02:00:00", "10", None, "20"),
        ("4", "ws", sku, "2024-01-01 03:00:00", "10", {"job_id": "j"}, "20"),
    ])
    r = audits.compute_efficiency(u).collect()[0]
    assert r.records_with_jobs == 1 and r.total_cost == 80.0 and r.cost_per_job_event == 80.0


def test_malformed_numbers_become_null(make_usage):
    u = make_usage([
        ("1", "ws", STD, "2024-01-01 00:00:00", "1", '{"cluster_id": "c", "autotermination_minutes": "abc"}', "1"),
        ("2", "ws", "SQL_PRO_COMPUTE", "2024-01-01 00:00:00", "1", '{"query_count_hourly": "x"}', "1"),
        ("3", "ws", "SQL_PRO_COMPUTE", "2024-01-01 01:00:00", "1", '{not json', "1"),
    ])
    assert audits.cluster_activity(u).collect()[0].autotermination_min is None
    eff = audits.compute_efficiency(u, min_cost=0).collect()
    assert [r.total_queries for r in eff if r.sku_name == "SQL_PRO_COMPUTE"] == [None]


def _prices(spark, rows):
    from spendaudit.sources.lookups import literal_frame
    df = literal_frame(spark, rows, "sku_name string, rate string, s string, e string")
    return df.select("sku_name",
                     F.struct(F.col("rate").cast("decimal(10,4)").alias("default")).alias("pricing"),
                     F.col("s").cast("timestamp").alias("price_start_time"),
                     F.col("e").cast("timestamp").alias("price_end_time"))


def test_unknown_sku_and_price_change_boundary(spark, make_usage):
    u = make_usage([
        ("1", "ws", "NEW_SKU", "2024-01-10 00:00:00", "10", None, None),
        ("2", "ws", PREM, "2024-01-14 23:00:00", "10", None, None),
        ("3", "ws", PREM, "2024-01-15 00:00:00", "10", None, None),
    ], with_cost=False)
    cat = {r.usage_record_id: r.estimated_cost_usd for r in with_catalog_cost(u).collect()}
    assert float(cat["1"]) == 2.0 and float(cat["2"]) == 5.5
    p = _prices(spark, [(PREM, "0.50", "2023-01-01 00:00:00", "2024-01-15 00:00:00"),
                        (PREM, "0.55", "2024-01-15 00:00:00", None)])
    lst = {r.usage_record_id: r.estimated_cost_usd for r in with_list_cost(u, p).collect()}
    assert lst["1"] is None and float(lst["2"]) == 5.0 and float(lst["3"]) == 5.5


def test_validity_index_equals_the_plain_join(spark, make_usage):
    """Overlapping, adjacent, open-ended, empty and reversed periods, periods without start
    or rate, SKUs whose prices all end: the index gives the rows of the left join, also
    with both joins shuffled."""
    import random
    random.seed(11)
    days = [f"20{y:02d}-{m:02d}-{d:02d} {h:02d}:00:00" for y in range(20, 26) for m in (1, 6, 12)
            for d in (1, 28) for h in (0, 13)]
    rows = [(sku, random.choice(["0.1", "0.25", None]), random.choice(days + [None]),
             random.choice(days + [None, None, None])) for sku in "ABCDEF" for _ in range(12)]
    rows += [("G", "0.5", "2021-01-01 00:00:00", None), ("H", "0.5", "2021-01-01 00:00:00",
                                                         "2021-01-01 00:00:01")]
    p = _prices(spark, rows)
    u = make_usage([(f"{sku}{i}{j}", "ws", sku, f"{t[:17]}0{j}", "3", None, None)
                    for sku in [*"ABCDEFGH", None] for i, t in enumerate(days) for j in range(2)]
                   + [("no-time", "ws", "A", None, "3", None, None)], with_cost=False)
    valid = ((F.col("usage_start_time") >= F.col("price_start_time"))
             & (F.col("price_end_time").isNull()
                | (F.col("usage_start_time") < F.col("price_end_time"))))
    plain = (u.join(p.withColumnRenamed("sku_name", "k"), (F.col("sku_name") == F.col("k")) & valid, "left")
             .select("usage_record_id", F.round(F.col("usage_quantity") * F.col("pricing.default"), 4)
                     .cast("decimal(18,4)").alias("estimated_cost_usd")))

    def listed(df):
        return sorted(map(repr, df.select("usage_record_id", "estimated_cost_usd").collect()))
    want = listed(plain)
    assert len(want) > u.count()  # overlaps duplicate records
    assert listed(with_list_cost(u, p)) == want
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shuffled = with_list_cost(u, p)
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        assert listed(shuffled) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_quality_gates_report_overlaps_duplicates_durations(spark, make_usage):
    u = make_usage([
        ("1", "ws", PREM, "2024-01-10 00:00:00", "1", None, None),
        ("1", "ws", PREM, "2024-01-10 01:00:00", "1", None, None),
        ("2", "ws", "NEW_SKU", "2024-01-10 00:00:00", "1", None, None, "2024-01-10 02:00:00"),
    ], with_cost=False)
    p = _prices(spark, [(PREM, "0.50", "2023-01-01 00:00:00", "2024-01-20 00:00:00"),
                        (PREM, "0.55", "2024-01-15 00:00:00", None)])
    g = {r.gate: r.failing_rows for r in compliance.quality_gates(u, p).collect()}
    assert g == {"duplicate_record_id": 2, "end_not_start_plus_1h": 1,
                 "unpriced_record": 1, "overlapping_price_period": 1}


def _daily(make_usage, costs, ws="ws", start=dt.date(2024, 1, 1), days=None):
    days = days or list(range(len(costs)))
    return make_usage([(f"{ws}-{d}", ws, "JOBS_COMPUTE", f"{start + dt.timedelta(days=d)} 10:00:00",
                        "1", None, str(c)) for d, c in zip(days, costs)])


def test_spike_history_edges(make_usage):
    s = {r.usage_date.day: r for r in audits.spend_spikes(_daily(make_usage, [10, 100])).collect()}
    assert list(s) == [2]  # day 1 has no baseline
    assert s[2].moving_avg_7d == 10.0 and s[2].stddev_7d is None and s[2].z_score is None
    assert s[2].alert_level == "EMERGENCY" and s[2].statistical_classification == "NORMAL"


def test_baseline_frame_counts_rows_not_days(make_usage):
    u = _daily(make_usage, [10, 20, 30, 100], days=[0, 1, 2, 9])
    r = audits.spend_spikes(u).collect()
    last = [x for x in r if x.usage_date.day == 10][0]
    assert last.moving_avg_7d == 20.0


def test_zero_baseline_is_filtered(make_usage):
    assert audits.spend_spikes(_daily(make_usage, [0, 5])).count() == 0


@pytest.mark.parametrize("cost,level", [(13.0, None), (17.5, "WARNING"), (25.0, "CRITICAL"),
                                        (25.01, "EMERGENCY")])
def test_alert_boundaries_are_strict(make_usage, cost, level):
    r = audits.spend_spikes(_daily(make_usage, [10, 10, cost])).collect()
    assert [x.alert_level for x in r if x.usage_date.day == 3] == ([level] if level else [])


def _flat_cluster(n, autoterm=0, job=None, start="2024-01-01 00:00:00"):
    meta = {"cluster_id": "z", "cluster_name": "idle", "autotermination_minutes": autoterm,
            "job_id": job, "data_security_mode": "NONE"}
    return [(f"z{i}", "ws-z", PREM, t, "4.0", meta, "2.2") for i, t in enumerate(hours(start, n))]


def test_hours_boundary_and_both_branches(make_usage):
    at_200 = audits.idle_clusters(make_usage(_flat_cluster(200))).collect()
    assert [r.detection_branch for r in at_200] == ["GOVERNANCE_VIOLATION"]
    both = audits.idle_clusters(make_usage(_flat_cluster(201))).collect()
    assert sorted(r.detection_branch for r in both) == ["BEHAVIORAL", "GOVERNANCE_VIOLATION"]
    assert {r.zombie_status for r in both} == {"HIGH"}
    crit = audits.idle_clusters(make_usage(_flat_cluster(401))).collect()
    assert {r.zombie_status for r in crit} == {"CRITICAL"}
    assert {r.recommended_action for r in crit} == {"APPLY_POLICY"}


@pytest.mark.parametrize("idle,label", [(1, "REVIEW"), (2, "MODERATE"), (3, "HIGH")])
def test_pipeline_idle_rate_boundaries(make_usage, idle, label):
    rows = []
    for i, t in enumerate(hours("2024-01-01 00:00:00", 4)):
        meta = {"pipeline_id": "p", "pipeline_mode": "CONTINUOUS",
                "data_processed_gb": 0.0 if i < idle else 3.5}
        rows.append((str(i), "ws", JOBS_SL, t, "1", meta, "1"))
    r = audits.pipeline_waste(make_usage(rows)).collect()[0]
    assert r.waste_classification == label


def test_weekend_predicate(spark):
    df = spark.createDataFrame([("2024-01-06 10:00:00",), ("2024-01-07 10:00:00",),
                                ("2024-01-05 23:00:00",), ("2024-01-08 00:00:00",)], "s string")
    got = [r[0] for r in df.select(is_weekend(F.col("s").cast("timestamp"))).collect()]
    assert got == [True, True, False, False]


def test_top_k_ties_broken_by_key(make_usage):
    u = make_usage([(w, w, STD, "2024-01-01 00:00:00", "1", None, "5") for w in ("c", "a", "b")])
    assert [r.workspace_id for r in audits.top_cost_centers(u, k=2).collect()] == ["a", "b"]


def test_nightly_sweep_ladder(make_usage):
    def cluster(cid, n, autoterm, job=None):
        meta = {"cluster_id": cid, "cluster_name": cid, "autotermination_minutes": autoterm,
                "job_id": job}
        return [(f"{cid}{i}", "ws", STD, t, "1", meta, "1")
                for i, t in enumerate(hours("2024-01-30 00:00:00", n))]
    u = make_usage(cluster("a", 12, 0) + cluster("b", 12, 30) + cluster("c", 6, 30)
                   + cluster("d", 3, 0, job="j") + cluster("e", 3, 30, job="j"))
    got = {r.cluster_id: r.action_required
           for r in monitors.nightly_idle_sweep(u, dt.date(2024, 1, 30)).collect()}
    assert got == {"a": "CRITICAL", "b": "TERMINATE", "c": "WARN", "d": "GOVERNANCE"}


def test_daily_alert_keeps_normal_days(make_usage):
    u = _daily(make_usage, [10, 10, 10], start=dt.date(2024, 1, 28))
    r = monitors.daily_alert(u, dt.date(2024, 1, 31)).collect()
    assert [(x.usage_date.day, x.alert_level) for x in r] == [(30, "NORMAL")]


def test_weekly_attribution_windows(make_usage):
    u = make_usage([("1", "ws", "JOBS_COMPUTE", "2024-01-24 00:00:00", "1", None, "5"),
                    ("2", "ws", "JOBS_COMPUTE", "2024-01-23 23:00:00", "1", None, "3"),
                    ("3", "ws", "JOBS_COMPUTE", "2024-01-16 23:00:00", "1", None, "100")])
    r = monitors.weekly_attribution(u, dt.date(2024, 1, 31)).collect()[0]
    assert (r.cost_this_week, r.cost_last_week, r.wow_delta_usd, r.usage_events) == (5.0, 3.0, 2.0, 2)


def test_daily_alert_pruned_equals_full_history(make_usage):
    # ws "a": active every day (recent window suffices); ws "b": idle for
    # 60 days before yesterday, so its baseline reaches far back
    rows = []
    for d in range(90):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
        rows.append((f"a{d}", "a", "JOBS_COMPUTE", f"{day} 10:00:00", "1", None, str(10 + d % 7)))
        if d < 25 or d == 89:
            rows.append((f"b{d}", "b", "JOBS_COMPUTE", f"{day} 10:00:00", "1", None, str(5 + d % 3)))
    u = make_usage(rows)
    as_of = dt.date(2024, 1, 1) + dt.timedelta(days=90)
    full = sorted(map(tuple, monitors.daily_alert(u, as_of, recent_days=None).collect()))
    pruned = sorted(map(tuple, monitors.daily_alert(u, as_of, recent_days=10).collect()))
    assert full == pruned and {r[1] for r in full} == {"a", "b"}


def test_calendar_dense_baseline_counts_idle_days_as_zero(make_usage):
    u = _daily(make_usage, [10, 20, 30, 100], days=[0, 1, 2, 9])
    dense = {r.usage_date.day: r for r in audits.spend_spikes(u, dense_days=True).collect()}
    # frame for day 10 = days 3..9 = [30, 0, 0, 0, 0, 0, 0] -> mean 30/7
    assert dense[10].moving_avg_7d == round(30 / 7, 2)
    assert 4 not in dense  # an idle day is never a spike


@pytest.mark.parametrize("words", [1 << 16, 1])
def test_duplicate_ids_with_a_hot_copy_group(make_usage, monkeypatch, words):
    """Exact with a sparse filter and with one so small that most ids pass it."""
    from spendaudit.functions import sieve
    monkeypatch.setattr(sieve, "WORDS", words)
    rows = [(f"u{i}", "ws", STD, "2024-01-01 00:00:00", "1", None, "1") for i in range(60)]
    rows += [("hot", "ws", STD, "2024-01-01 00:00:00", "1", None, "1")] * 30
    rows += [("twice", "ws", STD, "2024-01-01 00:00:00", "1", None, "1")] * 2
    got = compliance.duplicate_rows(make_usage(rows)).collect()
    assert got[0].failing_rows == 32


def test_catalog_category_and_lookup(spark):
    from spendaudit.functions.classify import catalog_category
    from spendaudit.sources.lookups import sku_catalog
    cat = {r.sku_name: (r.category, r.spend_category, r.attribution_category)
           for r in sku_catalog(spark).collect()}
    assert len(cat) == 12
    assert cat["DELTA_STORAGE"] == ("Storage", "Production / Value", "Platform")
    assert cat["VECTOR_SEARCH_COMPUTE"] == ("AI/ML", "AI / Innovation", "Platform")
    df = spark.createDataFrame([("UNITY_CATALOG_COMPUTE",), ("NEW_SKU",)], "sku_name string")
    assert [r[0] for r in df.select(catalog_category()).collect()] == ["Governance", None]


def test_dimension_lookups(spark):
    from spendaudit.sources.lookups import gpu_instances, workspaces
    gi = {r.instance_type: (r.relative_cost, r.status) for r in gpu_instances(spark).collect()}
    assert gi["g5.12xlarge"] == (1.0, "RECOMMENDED") and len(gi) == 6
    ws = {r.workspace_id: r.env for r in workspaces(spark).collect()}
    assert len(ws) == 8 and sorted(set(ws.values())) == ["development", "production", "sandbox", "staging"]


def test_daily_alert_dense_days(make_usage):
    # active on days 1..3 and on day 10 (yesterday for as_of = day 11)
    u = _daily(make_usage, [10, 20, 30, 100], days=[0, 1, 2, 9])
    as_of = dt.date(2024, 1, 11)
    rows = monitors.daily_alert(u, as_of).collect()
    assert [r.baseline_7d_avg for r in rows] == [20.0]            # rows 1..3
    dense = monitors.daily_alert(u, as_of, dense_days=True).collect()
    assert [r.baseline_7d_avg for r in dense] == [round(30 / 7, 2)]  # days 3..9


def test_catalog_cost_with_a_caller_catalogue(spark, make_usage):
    from spendaudit.sources.lookups import literal_frame
    u = make_usage([("1", "ws", STD, "2024-01-01 00:00:00", "10", None, None),
                    ("2", "ws", "NEW_SKU", "2024-01-01 00:00:00", "10", None, None)], with_cost=False)
    cat = literal_frame(spark, [(STD, "0.5")], "sku_name string, rate string")
    got = {r.usage_record_id: float(r.estimated_cost_usd)
           for r in with_catalog_cost(u, cat).collect()}
    assert got == {"1": 5.0, "2": 2.0}  # listed rate; default 0.20 for the unknown SKU


def test_daily_alert_keeps_the_history_of_a_null_workspace(make_usage):
    import datetime as dt

    from spendaudit.operators import monitors
    rows = [(f"{w}-{d}", w, "JOBS_COMPUTE", f"2024-01-{d:02d} 10:00:00", 1, None,
             100 if d == 30 else 10) for w in (None, "ws-a") for d in (1, 2, 3, 4, 30)]
    got = [{tuple(r) for r in monitors.daily_alert(make_usage(rows), dt.date(2024, 1, 31),
                                                   recent_days=n).collect()}
           for n in (None, 10)]
    assert got[0] == got[1] and len(got[0]) == 2
