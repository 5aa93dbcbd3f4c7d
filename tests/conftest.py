import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from spendaudit.plans.session import PY_DEFAULTS, SQL_DEFAULTS, ensure_checkpoint_dir
    b = (SparkSession.builder.master("local[*]").appName("spendaudit-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in {**SQL_DEFAULTS, **PY_DEFAULTS}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


def usage_rows(spark, rows, with_cost=True):
    """Usage DataFrame from tuples
    (id, workspace, sku, 'YYYY-MM-DD HH:MM:SS', quantity, metadata, cost);
    metadata may be a dict (dumped to JSON), a raw string or None; the end
    time is start + 1 hour unless an 8th element gives it."""
    from pyspark.sql import functions as F
    data = []
    for r in rows:
        meta = json.dumps(r[5]) if isinstance(r[5], dict) else r[5]
        end = r[7] if len(r) > 7 else None
        data.append((r[0], r[1], r[2], r[3], end, None if r[4] is None else str(r[4]), meta,
                     None if r[6] is None else str(r[6])))
    df = spark.createDataFrame(data, "usage_record_id string, workspace_id string, sku_name string, "
                                     "s string, e string, q string, usage_metadata string, c string")
    start = F.col("s").cast("timestamp")
    cols = [F.col("usage_record_id"), F.col("workspace_id"), F.col("sku_name"),
            start.alias("usage_start_time"),
            F.coalesce(F.col("e").cast("timestamp"), start + F.expr("INTERVAL 1 HOUR")).alias("usage_end_time"),
            F.col("q").cast("decimal(18,4)").alias("usage_quantity"),
            F.col("usage_metadata")]
    if with_cost:
        cols.append(F.col("c").cast("decimal(18,4)").alias("estimated_cost_usd"))
    return df.select(*cols)


@pytest.fixture
def make_usage(spark):
    return lambda rows, with_cost=True: usage_rows(spark, rows, with_cost)
