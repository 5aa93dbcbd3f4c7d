"""Dump ``explain("formatted")`` of every registered query.

``python -m spendaudit.plans.explain [sf_dir] [out_dir]`` writes one text file
per query into ``out_dir`` (default: a new folder under the temp directory)
and prints a one-line summary per query: shuffles, broadcasts, whether the
scan carries pushed or partition filters, and any plan node that should never
appear (cartesian / nested-loop joins, Python evaluation).
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas")


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def summary(text: str) -> dict:
    return {
        "shuffles": len(re.findall(r"^\(\d+\) Exchange", text, re.M)),
        "broadcasts": len(re.findall(r"^\(\d+\) BroadcastExchange", text, re.M)),
        "pushed_filters": "PushedFilters: [" in text and "PushedFilters: []" not in text,
        "partition_filters": "PartitionFilters: [" in text and "PartitionFilters: []" not in text,
        "forbidden": [f for f in FORBIDDEN if f in text],
    }


def main(argv) -> int:
    from .registry import queries
    from .session import local_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    out_dir = argv[1] if len(argv) > 1 else tempfile.mkdtemp(prefix="spendaudit-plans-")
    os.makedirs(out_dir, exist_ok=True)
    spark = local_session()
    bad = 0
    for name, fn in queries().items():
        text = formatted(fn(spark, sf_dir))
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as f:
            f.write(text)
        info = summary(text)
        bad += bool(info["forbidden"])
        print(name, info, flush=True)
    print("plans in", out_dir)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
