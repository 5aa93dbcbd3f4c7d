"""The composed batch jobs write the same answers as the operators."""

from conftest import SF_ORACLE
from spendaudit.operators import monitors, savings
from spendaudit.plans import jobs
from spendaudit.sources import events_usage as ev


def test_monitor_job_writes_each_result(spark, tmp_path):
    u = ev.fixture_usage(spark, SF_ORACLE)
    paths = jobs.run_monitors(u, ev.AS_OF, str(tmp_path / "out"),
                              rollup_path=str(tmp_path / "rollup"))
    assert len(paths) == 7
    got = spark.read.parquet(paths["daily_alert"])
    want = monitors.daily_alert(u, ev.AS_OF)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count() > 0
    again = jobs.run_monitors(u, ev.AS_OF, str(tmp_path / "out"))  # re-run replaces
    assert spark.read.parquet(again["daily_alert"]).count() == want.count()


def test_report_job(spark, tmp_path):
    u = ev.fixture_usage(spark, SF_ORACLE)
    paths = jobs.run_audit_report(u, ev.AS_OF, str(tmp_path / "rep"), rules=ev.fixture_rules())
    got = spark.read.parquet(paths["estimate_savings"])
    want = savings.estimate_savings(u, ev.fixture_rules())
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 5
