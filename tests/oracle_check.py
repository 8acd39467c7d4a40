"""Run registered Spark queries and their DuckDB oracles side by side.

    python tests/oracle_check.py [--sf DIR] [name ...]

Compares column names, row count and the multiset of rows (floats rounded
to 6 digits, columns in name order).
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return norm(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    res = {"name": name}
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    res["spark_s"] = round(time.time() - t0, 2)
    snames = df.columns
    res["rows"] = len(srows)
    if sql is None:
        res["status"] = "rows-only"
        return res
    t0 = time.time()
    rel = con.sql(sql)
    dnames = rel.columns
    drows = rel.fetchall()
    res["duck_s"] = round(time.time() - t0, 2)
    if sorted(snames) != sorted(dnames):
        res["status"] = f"COLUMNS spark={sorted(snames)} duck={sorted(dnames)}"
        return res
    if len(srows) != len(drows):
        res["status"] = f"ROWCOUNT spark={len(srows)} duck={len(drows)}"
        return res
    a, b = rows_of(snames, srows), rows_of(dnames, drows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"VALUES first diffs: {diff}"
        return res
    res["status"] = "ok"
    return res


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from sagebrush.session import get_session
    import __spark_entry__ as E

    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(args.sf)
    names = args.names or sorted(qs)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, qs[n], oracle.get(n), args.sf)
        except Exception as e:  # noqa: BLE001
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:600]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(json.dumps(r), flush=True)
    print(f"# {len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
