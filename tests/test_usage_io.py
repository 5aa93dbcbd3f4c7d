"""Record ids and numbering, the clustered writer, CSV import with quarantine."""

import glob
import json
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendaudit.operators import compliance
from spendaudit.sources import events_usage as ev
from spendaudit.sources import usage_io as io

PREM = "PREMIUM_ALL_PURPOSE_COMPUTE"
T0 = "2024-01-10 00:00:00"


def cluster(name):
    return {"cluster_id": name, "autotermination_minutes": 0}


@pytest.fixture
def collisions(make_usage):
    """Two clusters of one workspace, SKU, hour and quantity; two ends of one hour; a NULL
    and an empty metadata document; and a record delivered three times."""
    return make_usage([
        ("a", "ws", PREM, T0, "4", cluster("c1"), None),
        ("b", "ws", PREM, T0, "4", cluster("c2"), None),
        ("c", "ws", PREM, T0, "4", cluster("c2"), None, "2024-01-10 02:00:00"),
        ("d", "ws", PREM, T0, "4", None, None),
        ("e", "ws", PREM, T0, "4", "", None),
        ("f", "w", "sX", T0, "4", None, None),
        ("g", "ws", "X", T0, "4", None, None),
        ("h", "ws", PREM, None, None, None, None),
        *[(x, "ws", PREM, "2024-01-09 00:00:00", "1", cluster("c3"), None) for x in "ijk"],
    ], with_cost=False)


def test_ids_tell_different_records_apart_and_copies_share_one(spark, collisions):
    sent = collisions.withColumnRenamed("usage_record_id", "delivery")
    ids = {r.delivery: r.usage_record_id
           for r in io.with_record_ids(sent, ignore=("delivery",)).collect()}
    assert len(set(ids.values())) == 9 and len({ids[x] for x in "ijk"}) == 1
    swapped = sent.select(*reversed(sent.columns)).repartition(3)  # column order plays no part
    assert ids == {r.delivery: r.usage_record_id
                   for r in io.with_record_ids(swapped, ignore=("delivery",)).collect()}
    with_ids = io.with_record_ids(sent, ignore=("delivery",))
    assert compliance.duplicate_rows(with_ids).first()[0] == 3  # the gate finds the copies


def test_numbering_sorts_by_time_and_counts_copies(spark, collisions):
    got = sorted(io.number_records(collisions).collect(), key=lambda r: r.record_seq)
    assert [r.record_seq for r in got] == list(range(11))
    times = [r.usage_start_time for r in got]
    assert times[0] is None and times[1:] == sorted(times[1:])
    by = defaultdict(list)
    for r in got:
        by[r.usage_record_id].append((r.record_seq, r.occurrence))
    assert all([o for _, o in v] == list(range(len(v))) for v in by.values())
    assert Counter(map(len, by.values())) == {1: 8, 3: 1}


def test_numbers_do_not_depend_on_the_partitioning(spark, collisions, monkeypatch):
    monkeypatch.setattr(io, "COPIES_AT_ONCE", 7)
    hot = collisions.where("usage_record_id = 'i'").withColumn(
        "_c", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("_c")
    rows = collisions.unionByName(hot)
    key = ["usage_record_id", "occurrence", "record_seq"]
    a = sorted(tuple(r) for r in io.number_records(rows.repartition(1)).select(*key).collect())
    b = sorted(tuple(r) for r in io.number_records(rows.repartition(13)).select(*key).collect())
    assert a == b and len(a) == 111 and len({r[2] for r in a}) == 111
    assert max(r[1] for r in a) == 102
    assert io.number_records(collisions.limit(0)).collect() == []


def test_written_files_are_few_and_hold_disjoint_ranges(spark, tmp_path):
    """Rows come in 40 partitions that each hold every day: (partitions + days) files at
    most, each a stretch of the sort of the whole table."""
    u = ev.usage_table(spark, "/root/testdata/sf0.01").drop("usage_date").repartition(40)
    hot = u.limit(1).withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("_c")
    io.write_usage(u.unionByName(hot), str(tmp_path / "t"), partitions=6)
    files = glob.glob(str(tmp_path / "t" / "usage_date=*" / "*.parquet"))
    days = {f.split("usage_date=")[1][:10] for f in files}
    assert len(files) <= 6 + len(days) and len(days) == 30
    spans, sizes = defaultdict(list), Counter()
    for f in files:
        t = pq.read_table(f, columns=["sku_name", "usage_start_time"]).to_pylist()
        key = [(r["sku_name"], r["usage_start_time"]) for r in t]
        assert key == sorted(key)
        spans[f.split("usage_date=")[1][:10]].append((key[0], key[-1]))
        sizes[f.split("part-")[1][:5]] += len(t)
    for s in spans.values():
        s.sort()
        assert all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    # the hot record, a quarter of the rows, did not make one large task
    assert max(sizes.values()) <= 2 * sum(sizes.values()) / 6
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == u.count() + 3000


def test_csv_round_trip_keeps_every_value(spark, make_usage, tmp_path):
    doc = {"cluster_name": 'say "hi", twice', "note": "two\nlines", "é": "漢字"}
    u = make_usage([
        ("1", "ws", PREM, T0, "1.2345", json.dumps(doc, indent=1, ensure_ascii=False), "3"),
        ("2", None, "", "2024-02-29 23:59:59.000001", None, None, None),
        ("3", " padded ", "a,b", None, "-0.5", "not json\r\n{", "0.0001"),
        ("4", "ws", PREM, T0, "1", "", "1"),
    ])
    io.write_usage_csv(u, str(tmp_path / "csv"))
    counts = io.import_usage_csv(spark, str(tmp_path / "csv"), str(tmp_path / "t"),
                                 str(tmp_path / "q"))
    assert counts == {"read": 4, "good": 4, "bad": 0}
    back = io.read_usage_parquet(spark, str(tmp_path / "t")).drop("usage_date")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, u.select(*back.columns).collect()))


def test_csv_bad_records_are_set_aside_and_counted(spark, make_usage, tmp_path):
    header = ("usage_record_id,workspace_id,sku_name,usage_start_time,usage_end_time,"
              "usage_quantity,usage_metadata,estimated_cost_usd\n")
    good = '1,ws,X,2024-01-10 00:00:00.000000,2024-01-10 01:00:00.000000,1.5,"{""a"":\n1}",2.0\n'
    bad = ["2,ws\n", "3,ws,X,yesterday,2024-01-10 01:00:00.000000,1,,1\n",
           "4,ws,X,2024-01-10 00:00:00.000000,2024-01-10 01:00:00.000000,1,{},1,extra\n",
           ",ws,X,2024-01-10 00:00:00.000000,2024-01-10 01:00:00.000000,1,{},1\n"]
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text(header + good + "".join(bad[:2]))
    (tmp_path / "csv" / "b.csv").write_text(header + "".join(bad[2:]))
    counts = io.import_usage_csv(spark, str(tmp_path / "csv"), str(tmp_path / "t"), str(tmp_path / "q"))
    assert counts == {"read": 5, "good": 1, "bad": 4}
    row = io.read_usage_parquet(spark, str(tmp_path / "t")).collect()
    assert len(row) == 1 and row[0].usage_metadata == '{"a":\n1}'
    aside = spark.read.parquet(str(tmp_path / "q" / "bad")).collect()
    assert sorted(r.record.split(",")[0] for r in aside) == ["2", "3", "4", "no record id"]
    assert {r.file[-5:] for r in aside} == {"a.csv", "b.csv"}


def test_price_index_is_written_and_read_back(spark, tmp_path):
    from spendaudit.functions.costing import price_index, with_list_cost
    index = price_index(ev.fixture_prices(spark))
    io.write_price_index(index, str(tmp_path / "prices"))
    u = ev.usage_table(spark, SF_SMALL)
    a = with_list_cost(u, io.read_price_index(spark, str(tmp_path / "prices")))
    b = with_list_cost(u, ev.fixture_prices(spark))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == u.count()
