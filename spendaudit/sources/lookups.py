"""Small dimension DataFrames built from the fixed values in ``schema``.

Their row counts are fixed by construction, which is what lets joins
broadcast them without a size probe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import attribution_category, spend_category
from ..schema import GPU_INSTANCES, POLICY_RULES, SKU_CATALOG, WORKSPACES


def _sql_literal(v, typ: str) -> str:
    if v is None:
        return f"CAST(NULL AS {typ})"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_sql_literal(x, "string") for x in v) + ")"
    if isinstance(v, str):
        return "CAST('" + v.replace("\\", "\\\\").replace("'", "\\'") + f"' AS {typ})"
    return f"CAST({v!r} AS {typ})"


def literal_frame(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """A small literal table as one ``VALUES`` relation (a LocalRelation in
    the JVM: no Python worker, no RDD, one round trip).  ``ddl`` lists
    ``name type`` pairs separated by commas; its row count is fixed by the
    caller, which is what lets joins broadcast it without a size probe."""
    fields = [tuple(f.strip().split(None, 1)) for f in ddl.split(",")]
    values = ",\n  ".join(
        "(" + ", ".join(_sql_literal(v, t) for (_n, t), v in zip(fields, row)) + ")"
        for row in rows)
    names = ", ".join(n for n, _t in fields)
    return spark.sql(f"SELECT * FROM VALUES\n  {values}\nAS t({names})")


def sku_catalog(spark: SparkSession) -> DataFrame:
    df = literal_frame(spark, SKU_CATALOG, "sku_name string, rate string, category string")
    return (df.withColumn("rate", F.col("rate").cast("decimal(10,4)"))
              .withColumn("spend_category", spend_category())
              .withColumn("attribution_category", attribution_category()))


def workspaces(spark: SparkSession, rows=None) -> DataFrame:
    return literal_frame(spark, rows if rows is not None else WORKSPACES,
                         "workspace_id string, team string, industry string, env string, "
                         "budget_daily_dbu int, label string")


def gpu_instances(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, GPU_INSTANCES, "instance_type string, gpu string, memory_gb int, "
                                               "relative_cost double, status string")


def policy_rules(spark: SparkSession, rows=None) -> DataFrame:
    rows = rows if rows is not None else POLICY_RULES
    return literal_frame(spark, rows, "policy string, scope string, field string, kind string, "
                                      "min_value int, max_value int, allowed array<string>")
