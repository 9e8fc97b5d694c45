"""Differential check: Spark query vs DuckDB oracle on the same parquet tables.

Usage: python -m tests.harness [sf_dir] [name ...]
Mirrors the driver's gate: column names sorted, row count, order-insensitive
value comparison.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from vitrine.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"memory_limit": "8GB", "threads": 4})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        import pandas as pd
        if v is pd.NaT or (not isinstance(v, (str, bytes)) and pd.isna(v)):
            return None
    except (TypeError, ValueError):
        pass
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    out.sort(key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))
    return cols, out


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    sc, sr = rows_of(s_cols, s_rows)
    dc, dr = rows_of(d_cols, d_rows)
    ok = sc == dc and len(sr) == len(dr) and sr == dr
    info = {"name": name, "ok": ok, "spark_rows": len(sr), "duck_rows": len(dr),
            "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if sc != dc:
        info["cols"] = (sc, dc)
    elif not ok:
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        info["only_spark"] = diff_s
        info["only_duck"] = diff_d
    return info


def main(argv):
    from vitrine.plans.oracle import ORACLE
    from vitrine.plans.registry import QUERIES
    from vitrine.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or [n for n in QUERIES if n in ORACLE]
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            info = compare(spark, con, n, QUERIES[n], ORACLE[n], sf_dir)
        except Exception as e:  # report and go on
            info = {"name": n, "ok": False, "error": repr(e)[:800]}
        bad += not info["ok"]
        print(info, flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
