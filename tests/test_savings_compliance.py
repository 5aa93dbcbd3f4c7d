"""Savings masks, compliance rules, metamorphic properties, readers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from spendaudit.operators import audits, compliance, reports, savings
from spendaudit.sources import events_usage as ev
from spendaudit.sources.usage_io import read_usage_csv, write_usage, write_usage_csv

def test_default_rule_masks(make_usage):
    rows = [
        ("1", "ws-zombie-008", "PREMIUM_ALL_PURPOSE_COMPUTE", "2026-01-01 00:00:00", "1", None, "10"),
        ("2", "ws-prod-bi-004", "SERVERLESS_SQL_COMPUTE", "2026-02-09 23:00:00", "1", None, "7"),
        ("3", "ws-prod-bi-004", "SERVERLESS_SQL_COMPUTE", "2026-02-10 00:00:00", "1", None, "20"),
        ("4", "ws-prod-bi-004", "SERVERLESS_SQL_COMPUTE", "2026-02-13 00:00:00", "1", None, "7"),
        ("5", "ws-sandbox-ds-005", "STANDARD_ALL_PURPOSE_COMPUTE", "2026-01-03 12:00:00", "1", None, "4"),
        ("6", "ws-sandbox-ds-005", "STANDARD_ALL_PURPOSE_COMPUTE", "2026-01-02 12:00:00", "1", None, "9"),
        ("7", "ws-fsi-trading-001", "JOBS_SERVERLESS_COMPUTE", "2026-01-01 00:00:00", "1",
         {"pipeline_id": "p"}, "10"),
        ("8", "ws-fsi-trading-001", "JOBS_SERVERLESS_COMPUTE", "2026-01-01 00:00:00", "1",
         {"pipeline_id": ""}, "5"),
        ("9", "ws-retail-forecast-002", "GPU_SERVERLESS_COMPUTE", "2026-01-01 00:00:00", "1", None, "30"),
    ]
    u = make_usage(rows)
    got = {r.finding: r for r in savings.estimate_savings(u).collect()}
    assert {k: v.cost_before_90d for k, v in got.items()} == {
        "idle_cluster": 10.0, "sql_spike": 20.0, "gpu_overprovisioning": 30.0,
        "weekend_dev": 4.0, "continuous_pipeline": 10.0}
    z = got["idle_cluster"]
    assert (z.cost_after_90d, z.savings_90d, z.savings_annual) == (0.5, 9.5, 38.53)
    w = savings.waste_summary(u).collect()[0]
    # the waste summary counts all pipeline-SKU spend (15) at 60 %, GPU at 50 %
    assert w.continuous_pipeline_waste_usd == 9.0 and w.gpu_overprovisioning_waste_usd == 15.0
    assert w.total_waste_90d == 10 + 20 + 15 + 4 + 9
    roll = savings.savings_rollup(u).collect()[0]
    assert roll.total_cost_before_90d == 74.0 and roll.workspaces_audited == 5


def test_rollup_equals_sum_of_rows_and_shares_sum_to_100(spark):
    u = ev.fixture_usage(spark, SF_ORACLE)
    rules = ev.fixture_rules()
    rows = savings.estimate_savings(u, rules).collect()
    roll = savings.savings_rollup(u, rules).collect()[0]
    assert roll.total_savings_annual == pytest.approx(sum(r.savings_annual for r in rows), abs=0.011)
    assert roll.total_cost_before_90d == pytest.approx(sum(r.cost_before_90d for r in rows), abs=0.011)
    shares = [r.pct_of_total_spend for r in audits.top_cost_centers(u, k=100).collect()]
    assert sum(shares) == pytest.approx(100.0, abs=0.5)
    bars = reports.waterfall(u, rules).collect()
    net = [b for b in bars if b.kind == "total"][0]
    base = [b for b in bars if b.kind == "base"][0]
    assert net.height == pytest.approx(base.delta - sum(r.savings_annual for r in rows), abs=0.02)


def test_results_do_not_depend_on_partitioning(spark):
    u = ev.fixture_usage(spark, SF_ORACLE)
    for fn in (audits.top_cost_centers, audits.spend_spikes, audits.cluster_activity):
        a = sorted(map(tuple, fn(u).collect()), key=repr)
        b = sorted(map(tuple, fn(u.repartition(3, "usage_record_id")).collect()), key=repr)
        c = sorted(map(tuple, fn(u.coalesce(1)).collect()), key=repr)
        assert a == b == c


def test_policy_rules(make_usage):
    u = make_usage([
        ("1", "ws", "STANDARD_ALL_PURPOSE_COMPUTE", "2024-01-01 00:00:00", "1",
         {"cluster_id": "a", "autotermination_minutes": 0, "instance_type": "m5.2xlarge",
          "data_security_mode": "USER_ISOLATION"}, "1"),
        ("2", "ws", "STANDARD_ALL_PURPOSE_COMPUTE", "2024-01-01 00:00:00", "1",
         {"cluster_id": "b", "autotermination_minutes": 60, "instance_type": "i3.xlarge",
          "data_security_mode": "NONE"}, "1"),
        ("3", "ws", "GPU_SERVERLESS_COMPUTE", "2024-01-01 00:00:00", "1",
         {"job_name": "t", "instance_type": "p4d.24xlarge", "autotermination_minutes": 30}, "1"),
        ("4", "ws", "JOBS_COMPUTE", "2024-01-01 00:00:00", "1",
         {"cluster_id": "x", "autotermination_minutes": 0}, "1"),
    ])
    got = {(r.resource_id, r.field, r.kind) for r in compliance.policy_compliance(u).collect()}
    assert got == {("a", "autotermination_minutes", "range"), ("b", "instance_type", "allowlist"),
                   ("b", "data_security_mode", "fixed"), ("t", "instance_type", "allowlist")}


def test_budget_thresholds(make_usage):
    u = make_usage([("1", "w1", "JOBS_COMPUTE", "2024-01-30 01:00:00", "79", None, "1"),
                    ("2", "w2", "JOBS_COMPUTE", "2024-01-30 01:00:00", "80", None, "1"),
                    ("3", "w3", "JOBS_COMPUTE", "2024-01-30 01:00:00", "100", None, "1"),
                    ("4", "w4", "JOBS_COMPUTE", "2024-01-30 01:00:00", "100.01", None, "1")])
    budgets = [("workspace", w, 100, 80) for w in ("w1", "w2", "w3", "w4")]
    got = {r.scope_id: r.status
           for r in compliance.budget_status(u, dt.date(2024, 1, 31), budgets=budgets).collect()}
    assert got == {"w1": "OK", "w2": "ALERT", "w3": "ALERT", "w4": "OVER_LIMIT"}


def test_right_size_and_off_hours(spark):
    u = ev.fixture_usage(spark, SF_ORACLE)
    rs = compliance.right_size_candidates(u, ev.AS_OF).collect()
    assert rs and all(r.instance_type == "p4d.24xlarge" and r.recommended_instance == "g5.12xlarge"
                      for r in rs)
    off = compliance.off_hours_candidates(u, ev.AS_OF, workspace_rows=ev.fixture_workspace_rows()).collect()
    assert {r.env for r in off} <= {"sandbox", "development", "staging"}


def test_csv_and_partitioned_parquet_round_trip(spark, tmp_path):
    u = ev.fixture_usage(spark, "/root/testdata/sf0.001").drop("usage_date")
    write_usage_csv(u, str(tmp_path / "csv"))
    back = read_usage_csv(spark, str(tmp_path / "csv"))
    assert back.exceptAll(u).count() == 0 and u.exceptAll(back).count() == 0
    write_usage(u, str(tmp_path / "pq"))
    from spendaudit.sources.usage_io import read_usage_parquet
    pq = read_usage_parquet(spark, str(tmp_path / "pq"))
    assert pq.drop("usage_date").exceptAll(u).count() == 0


def test_record_ids_are_unique_and_stable(spark):
    from spendaudit.sources.usage_io import with_record_ids
    u = ev.usage_table(spark, SF_ORACLE)
    a = with_record_ids(u).select("usage_record_id")
    b = with_record_ids(u.repartition(5)).select("usage_record_id")
    n = u.count()
    assert a.distinct().count() == n
    assert a.exceptAll(b).count() == 0
    assert a.filter(~a.usage_record_id.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")).count() == 0


def test_dimension_tables_as_dataframes(spark):
    from spendaudit.sources.lookups import literal_frame
    u = ev.fixture_usage(spark, SF_ORACLE)
    rows = ev.fixture_budgets()
    as_list = compliance.budget_status(u, ev.AS_OF, budgets=rows)
    as_df = compliance.budget_status(u, ev.AS_OF, budgets=literal_frame(spark, rows, compliance.BUDGET_DDL))
    assert as_list.exceptAll(as_df).count() == 0 and as_list.count() == as_df.count() > 0
    ws_rows = ev.fixture_workspace_rows()
    a = compliance.off_hours_candidates(u, ev.AS_OF, workspace_rows=ws_rows)
    b = compliance.off_hours_candidates(
        u, ev.AS_OF, workspace_rows=literal_frame(spark, ws_rows, compliance.WORKSPACE_DDL))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0


def test_read_prices_with_a_wider_pricing_struct(spark, tmp_path):
    from spendaudit.sources.usage_io import read_prices
    from spendaudit.functions.costing import with_list_cost
    wide = ev.fixture_prices(spark).withColumn(
        "pricing", F.struct(F.col("pricing.default").alias("default"),
                            (F.col("pricing.default") * 0.9).alias("promotional")))
    wide.write.parquet(str(tmp_path / "prices"))
    p = read_prices(spark, str(tmp_path / "prices"))
    u = ev.usage_table(spark, "/root/testdata/sf0.001")
    a = with_list_cost(u, p).select("usage_record_id", "estimated_cost_usd")
    b = with_list_cost(u, ev.fixture_prices(spark)).select("usage_record_id", "estimated_cost_usd")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_written_usage_files_are_ordered_for_row_group_skipping(spark, tmp_path):
    import glob
    import pyarrow.parquet as pq
    u = ev.usage_table(spark, "/root/testdata/sf0.001").drop("usage_date").repartition(3)
    write_usage(u, str(tmp_path / "pq"))
    files = glob.glob(str(tmp_path / "pq" / "usage_date=*" / "*.parquet"))
    assert files
    for f in files:
        t = pq.read_table(f, columns=["sku_name", "usage_start_time", "workspace_id"]).to_pylist()
        keys = [(r["sku_name"], r["usage_start_time"], r["workspace_id"]) for r in t]
        assert keys == sorted(keys)


def test_savings_rule_cluster_filter(make_usage):
    rows = [("1", "ws-a", "PREMIUM_ALL_PURPOSE_COMPUTE", "2026-01-01 00:00:00", "1",
             {"cluster_id": "zombie"}, "10"),
            ("2", "ws-a", "PREMIUM_ALL_PURPOSE_COMPUTE", "2026-01-01 00:00:00", "1",
             {"cluster_id": "busy"}, "7")]
    whole = savings.SavingsRule("idle", ("ws-a",), ("PREMIUM_ALL_PURPOSE_COMPUTE",), "0.05")
    one = savings.SavingsRule("idle_one", ("ws-a",), ("PREMIUM_ALL_PURPOSE_COMPUTE",), "0.05",
                              clusters=("zombie",))
    got = {r.finding: r.cost_before_90d
           for r in savings.estimate_savings(make_usage(rows), [whole, one]).collect()}
    assert got == {"idle": 17.0, "idle_one": 10.0}
