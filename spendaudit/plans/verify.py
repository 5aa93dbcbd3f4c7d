"""Spark-vs-DuckDB comparison of registered queries (the driver's gate, run
locally).  ``python -m spendaudit.plans.verify [sf_dir] [name ...]``"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    """Exact comparison: every double the operators emit is rounded through a
    decimal, so both engines produce bit-identical values."""
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat() if not hasattr(v, "to_pydatetime") else v.to_pydatetime().isoformat()
    if hasattr(v, "as_tuple"):  # Decimal
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    ok = ok_cols and a == b
    info = {"name": name, "ok": ok, "rows": (len(s_rows), len(d_rows)),
            "spark_s": round(t1 - t0, 2)}
    if not ok_cols:
        info["cols"] = (sorted(set(s_cols) - set(d_cols)), sorted(set(d_cols) - set(s_cols)))
    elif not ok:
        diff_a = [r for r in a if r not in b][:3]
        diff_b = [r for r in b if r not in a][:3]
        info["cols"] = sorted(s_cols)
        info["spark_only"] = diff_a
        info["duck_only"] = diff_b
    return info


def main(argv):
    from ..plans.registry import oracle_sql, queries
    from .session import local_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            print({"name": name, "ok": None, "note": "no oracle"})
            continue
        try:
            info = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # report and continue
            info = {"name": name, "ok": False, "error": repr(e)[:600]}
        bad += not info["ok"]
        print(info, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
