"""Schemas of the usage fact, the price dimension and the metadata document,
plus the small fixed lookup tables every audit needs.

Money is carried as ``decimal(18,4)`` so that sums are exact and independent of
partitioning; operators cast their rounded outputs to ``double`` at the edge.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
RATE = T.DecimalType(10, 4)

USAGE_SCHEMA = T.StructType([
    T.StructField("usage_record_id", T.StringType(), False),
    T.StructField("workspace_id", T.StringType(), True),
    T.StructField("sku_name", T.StringType(), True),
    T.StructField("usage_start_time", T.TimestampType(), True),
    T.StructField("usage_end_time", T.TimestampType(), True),
    T.StructField("usage_quantity", MONEY, True),
    T.StructField("usage_metadata", T.StringType(), True),
])

# Exported files (and the 50-row sample) carry the derived cost column too.
COSTED_USAGE_SCHEMA = T.StructType(
    USAGE_SCHEMA.fields + [T.StructField("estimated_cost_usd", MONEY, True)])

PRICES_SCHEMA = T.StructType([
    T.StructField("sku_name", T.StringType(), False),
    T.StructField("pricing", T.StructType([T.StructField("default", RATE, True)]), True),
    T.StructField("price_start_time", T.TimestampType(), False),
    T.StructField("price_end_time", T.TimestampType(), True),
])

# Every metadata key any operator reads.  All are parsed as strings (a JSON
# number is kept as its text, JSON null and a missing key both become NULL)
# and typed afterwards with try_cast, so one malformed value never nulls the
# whole document or fails the job.
META_FIELDS = (
    "cluster_id", "cluster_name", "job_id", "job_name", "autotermination_minutes",
    "data_security_mode", "instance_type", "gpu_type", "gpu_utilization_pct",
    "warehouse_id", "warehouse_name", "query_count_hourly", "pipeline_id",
    "pipeline_name", "pipeline_mode", "trigger_interval", "target_table",
    "data_processed_gb",
)
META_SCHEMA = T.StructType([T.StructField(f, T.StringType(), True) for f in META_FIELDS])


# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the audited platform's catalogue and the
# audit's published rules for results to be right.  Stated once, in catalogue
# order.
# ---------------------------------------------------------------------------

# SKU catalogue: (sku_name, list rate USD per unit, catalogue category)
SKU_CATALOG = [
    ("STANDARD_ALL_PURPOSE_COMPUTE", "0.40", "Interactive"),
    ("PREMIUM_ALL_PURPOSE_COMPUTE", "0.55", "Interactive"),
    ("JOBS_COMPUTE", "0.15", "Production"),
    ("JOBS_SERVERLESS_COMPUTE", "0.20", "Production"),
    ("SQL_PRO_COMPUTE", "0.22", "BI/SQL"),
    ("SERVERLESS_SQL_COMPUTE", "0.35", "BI/SQL"),
    ("SERVERLESS_REAL_TIME_INFERENCE", "0.65", "AI/ML"),
    ("GPU_SERVERLESS_COMPUTE", "1.20", "AI/ML"),
    ("FOUNDATION_MODEL_TRAINING", "2.50", "AI/ML"),
    ("VECTOR_SEARCH_COMPUTE", "0.30", "AI/ML"),
    ("DELTA_STORAGE", "0.02", "Storage"),
    ("UNITY_CATALOG_COMPUTE", "0.10", "Governance"),
]
DEFAULT_RATE = "0.20"  # rate applied to a SKU missing from the catalogue

INTERACTIVE_SKUS = ("STANDARD_ALL_PURPOSE_COMPUTE", "PREMIUM_ALL_PURPOSE_COMPUTE")
SQL_SKUS = ("SERVERLESS_SQL_COMPUTE", "SQL_PRO_COMPUTE")
GPU_SKUS = ("GPU_SERVERLESS_COMPUTE", "FOUNDATION_MODEL_TRAINING")
PIPELINE_SKU = "JOBS_SERVERLESS_COMPUTE"
GPU_CHART_SKU = "GPU_SERVERLESS_COMPUTE"

# Spend taxonomy used by the SKU breakdown and the category chart:
# value-producing, AI, interactive; everything else is platform.
TAXONOMY_A_PRODUCTION = ("JOBS_COMPUTE", "JOBS_SERVERLESS_COMPUTE", "SQL_PRO_COMPUTE",
                         "SERVERLESS_SQL_COMPUTE", "DELTA_STORAGE")
TAXONOMY_A_AI = ("GPU_SERVERLESS_COMPUTE", "FOUNDATION_MODEL_TRAINING",
                 "SERVERLESS_REAL_TIME_INFERENCE", "VECTOR_SEARCH_COMPUTE")
# Spend taxonomy used by the weekly attribution monitor (storage and vector
# search fall to platform here).
TAXONOMY_B_PRODUCTION = ("JOBS_COMPUTE", "JOBS_SERVERLESS_COMPUTE", "SQL_PRO_COMPUTE",
                         "SERVERLESS_SQL_COMPUTE")
TAXONOMY_B_AI = ("GPU_SERVERLESS_COMPUTE", "FOUNDATION_MODEL_TRAINING",
                 "SERVERLESS_REAL_TIME_INFERENCE")

# Workspaces of the audited estate:
# (workspace_id, team, industry, env, daily DBU budget, display label)
WORKSPACES = [
    ("ws-fsi-trading-001", "Data Engineering", "Financial Services", "production", 850, "fsi-trading"),
    ("ws-retail-forecast-002", "ML Platform", "Retail", "production", 650, "retail-forecast"),
    ("ws-health-analytics-003", "Analytics", "Healthcare", "development", 320, "health-analytics"),
    ("ws-prod-bi-004", "BI & Reporting", "Enterprise", "production", 420, "prod-bi"),
    ("ws-sandbox-ds-005", "Data Science", "Cross-industry", "sandbox", 210, "sandbox-ds"),
    ("ws-ai-serving-006", "AI Serving", "Tech", "production", 550, "ai-serving"),
    ("ws-staging-007", "Platform Ops", "Internal", "staging", 260, "staging"),
    ("ws-zombie-008", "Legacy Migration", "Internal", "production", 160, "zombie-legacy"),
]
NON_PROD_ENVS = ("sandbox", "development", "staging")

# GPU instance reference: (instance_type, gpu, memory_gb, relative_cost, status)
GPU_INSTANCES = [
    ("p4d.24xlarge", "A100 x8", 320, 3.2, "OVERPROVISIONED"),
    ("g5.12xlarge", "A10G x4", 96, 1.0, "RECOMMENDED"),
    ("g5.48xlarge", "A10G x8", 192, 1.8, "INTERMEDIATE"),
    ("p3.2xlarge", "V100 x1", 16, 0.6, "EXPERIMENTATION"),
    ("g5.xlarge", "A10G x1", 24, 0.4, "INFERENCE"),
    ("g4dn.xlarge", "T4 x1", 16, 0.3, "LIGHTWEIGHT"),
]
# Instances the GPU monitor proposes to right-size when under 50 % busy.
LARGE_GPU_INSTANCES = ("p4d.24xlarge", "p3dn.24xlarge")

# Compute-policy rules: (policy, sku scope, field, kind, min, max, allowed values)
POLICY_RULES = [
    ("interactive", "interactive", "autotermination_minutes", "range", 15, 120, None),
    ("interactive", "interactive", "instance_type", "allowlist", None, None,
     ("m5.2xlarge", "m5.4xlarge", "r5.xlarge", "r5.2xlarge", "c5.4xlarge")),
    ("interactive", "interactive", "data_security_mode", "fixed", None, None, ("USER_ISOLATION",)),
    ("gpu", "gpu", "instance_type", "allowlist", None, None,
     ("g4dn.xlarge", "g5.xlarge", "g5.12xlarge", "g5.48xlarge", "p3.2xlarge")),
    ("gpu", "gpu", "autotermination_minutes", "range", 15, 60, None),
]

# Daily DBU budgets of the serverless BI warehouse and of the continuous
# pipeline, alert at 80 %.
BUDGET_WAREHOUSE_ID = "sql-wh-bi-auto-004"
WAREHOUSE_DAILY_DBU_LIMIT = 300
BUDGET_PIPELINE_ID = "pipe-risk-factor-etl"
PIPELINE_DAILY_DBU_LIMIT = 150
BUDGET_ALERT_PCT = 80

AUDIT_DAYS = 90
