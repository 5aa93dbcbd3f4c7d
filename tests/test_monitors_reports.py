"""Hand-row tests of monitor ladders and report datasets."""

import datetime as dt

import pytest

from spendaudit.operators import monitors, reports

SQL, GPU = "SERVERLESS_SQL_COMPUTE", "GPU_SERVERLESS_COMPUTE"


def _hourly(costs, start="2024-01-30 00:00:00", wh="w1", name="n"):
    t0 = dt.datetime.fromisoformat(start)
    return [(f"{wh}-{i}", "ws", SQL, (t0 + dt.timedelta(hours=i)).strftime("%Y-%m-%d %H:%M:%S"),
             "1", {"warehouse_id": wh, "warehouse_name": name, "query_count_hourly": 3}, str(c))
            for i, c in enumerate(costs)]


@pytest.mark.parametrize("last,level", [(20, None), (20.01, "WARNING"), (50, "WARNING"),
                                        (50.01, "CRITICAL")])
def test_warehouse_spike_multiples(make_usage, last, level):
    u = make_usage(_hourly([10, 10, 10, last]))
    r = monitors.warehouse_hourly_spikes(u, dt.datetime(2024, 1, 31)).collect()
    assert [x.alert_level for x in r] == ([level] if level else [])
    if level:
        assert r[0].avg_24h_cost == 10.0 and r[0].total_queries == 3


def test_warehouse_window_is_last_24_hours(make_usage):
    u = make_usage(_hourly([100, 1, 1, 50], start="2024-01-29 22:00:00"))
    # the 100 at 22:00 on the 29th lies outside [as_of - 24h, as_of): baseline is 1
    r = monitors.warehouse_hourly_spikes(u, dt.datetime(2024, 1, 31)).collect()
    assert [(x.hourly_cost, x.avg_24h_cost, x.alert_level) for x in r] == [(50.0, 1.0, "CRITICAL")]


def test_gpu_ladder(make_usage):
    def job(name, inst, util, n=2):
        return [(f"{name}{i}", "ws", GPU, f"2024-01-30 0{i}:00:00", "1",
                 {"job_name": name, "instance_type": inst, "gpu_type": "A",
                  "gpu_utilization_pct": util}, "5") for i in range(n)]
    u = make_usage(job("a", "p4d.24xlarge", 45.0) + job("b", "g5.xlarge", 30.0)
                   + job("c", "g5.xlarge", 59.9) + job("d", "g5.xlarge", 60.0)
                   + [("e0", "ws", GPU, "2024-01-30 00:00:00", "1", {"job_name": "e"}, "5")])
    got = {r.job_name: (r.avg_gpu_util_pct, r.recommendation)
           for r in monitors.gpu_utilization(u, dt.date(2024, 1, 31)).collect()}
    assert got == {"a": (45.0, "RIGHT_SIZE"), "b": (30.0, "CRITICAL"), "c": (59.9, "WARNING"),
                   "d": (60.0, "HEALTHY"), "e": (None, "HEALTHY")}


def test_pipeline_daily_status(make_usage):
    rows = []
    for day, idle in (("2024-01-29", 3), ("2024-01-30", 1)):
        for h in range(4):
            rows.append((f"{day}{h}", "ws", "JOBS_SERVERLESS_COMPUTE", f"{day} 0{h}:00:00", "1",
                         {"pipeline_id": "p", "pipeline_mode": "CONTINUOUS",
                          "data_processed_gb": 0.0 if h < idle else 2.0}, "2.5"))
    got = {r.usage_date.day: (r.idle_hours, r.idle_rate_pct, r.status, r.projected_annual_cost,
                              r.recoverable_daily)
           for r in monitors.pipeline_daily(make_usage(rows), dt.date(2024, 1, 31)).collect()}
    assert got == {29: (3, 75.0, "CRITICAL", 3650.0, 6.0), 30: (1, 25.0, "REVIEW", 3650.0, 6.0)}


def test_daily_burn_min_periods_and_flags(make_usage):
    rows = [(str(d), "ws-z" if d % 2 else "ws", "JOBS_COMPUTE", f"2024-01-{d:02d} 10:00:00", "1",
             None, str(d)) for d in range(1, 9)]
    got = {r.usage_date.day: r for r in reports.daily_burn(
        make_usage(rows), spike_window=(dt.date(2024, 1, 3), dt.date(2024, 1, 4)),
        idle_workspace="ws-z", audit_days=8).collect()}
    assert [got[d].rolling_7d_avg for d in range(1, 9)] == [None, None, None, 2.5, 3.0, 3.5, 4.0, 5.0]
    assert [d for d in got if got[d].in_anomaly_window] == [3, 4]
    assert [d for d in got if got[d].is_peak] == [8]
    assert got[1].idle_ws_daily_avg == (1 + 3 + 5 + 7) / 8


def test_gpu_chart_defaults_missing_utilisation(make_usage):
    rows = [("1", "ws-a", GPU, "2024-01-01 00:00:00", "1", {"gpu_utilization_pct": 20.0}, "30"),
            ("2", "ws-a", GPU, "2024-01-01 01:00:00", "1", {}, "30"),
            ("3", "ws-b", GPU, "2024-01-01 00:00:00", "1", {"gpu_utilization_pct": 80.0}, "15")]
    got = [(r.position, r.workspace_id, r.label, r.avg_gpu_util_pct, r.low_utilization, r.bubble_size)
           for r in reports.gpu_util_vs_cost(make_usage(rows), {"ws-a": "A"}).collect()]
    assert sorted(got) == [(1, "ws-a", "A", 35.0, True, 960.0), (2, "ws-b", None, 80.0, False, 285.0)]


def test_category_spend_and_waterfall_shape(make_usage):
    rows = [("1", "ws", "GPU_SERVERLESS_COMPUTE", "2024-01-01 00:00:00", "1", None, "30"),
            ("2", "ws", "DELTA_STORAGE", "2024-01-01 00:00:00", "1", None, "10"),
            ("3", "ws", "UNITY_CATALOG_COMPUTE", "2024-01-01 00:00:00", "1", None, "10")]
    cats = {r.spend_category: r.pct_of_total for r in reports.category_spend(make_usage(rows)).collect()}
    assert cats == {"AI / ML": 60.0, "Production": 20.0, "Platform": 20.0}
    bars = reports.waterfall(make_usage(rows)).collect()
    assert [b.kind for b in sorted(bars, key=lambda b: b.step)] == ["base"] + ["save"] * 5 + ["total"]
