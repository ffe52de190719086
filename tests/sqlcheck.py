"""Run registered queries beside their SQL twins and compare rows.

``python tests/sqlcheck.py [--sf 0.01] [key ...]``
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
       "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"dec:{v}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v)


KIND = {"bigint": "bigint", "int": "int", "string": "varchar", "double": "double", "boolean": "boolean",
        "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date"}
DUCK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "varchar", "DOUBLE": "double", "BOOLEAN": "boolean",
        "TIMESTAMP": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamptz", "DATE": "date"}


def compare(df, con, sql: str) -> str:
    """Empty when equal, else what differs."""
    names = sorted(df.columns)
    types = dict(df.dtypes)
    rows = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    dnames = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    data = cur.fetchall()
    if sorted(dnames) != names:
        return f"columns {names} vs {sorted(dnames)}"
    order = [dnames.index(n) for n in names]
    drows = sorted(tuple(plain(r[i]) for i in order) for r in data)
    odd = [(n, types[n], dtypes[n]) for n in names if KIND.get(types[n], types[n]) != DUCK.get(dtypes[n], dtypes[n])]
    if odd:
        return f"types {odd}"
    if len(rows) != len(drows):
        return f"rows {len(rows)} vs {len(drows)}"
    bad = [(a, b) for a, b in zip(rows, drows) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ; {names} first {str(bad[0])[:600]}"
    return ""


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("keys", nargs="*")
    a = args.parse_args()
    import __spark_entry__ as entry
    from skyspine.session import local_session

    spark = local_session("8")
    sf_dir = f"/root/testdata/sf{a.sf}"
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    keys = [k for k in queries if not a.keys or any(k.startswith(x) for x in a.keys)]
    failed = []
    for k in keys:
        t = time.time()
        try:
            df = queries[k](spark, sf_dir)
            if k in oracle:
                why = compare(df, con, oracle[k])
                n = -1
            else:
                n = df.count()
                why = "" if n else "no rows"
        except Exception as e:  # a failing query must not stop the rest of the report
            why = f"{type(e).__name__}: {str(e)[:700]}"
            if len(keys) < 4:
                traceback.print_exc()
            n = -1
        took = time.time() - t
        flag = "ok  " if not why else "FAIL"
        print(f"{flag} {k} {took:.1f}s {'rows-only ' + str(n) if k not in oracle else ''} {why}", flush=True)
        if why:
            failed.append(k)
    print(f"{len(keys) - len(failed)} of {len(keys)} equal; failed: {failed}; unregistered twins: "
          f"{sorted(set(oracle) - set(queries))}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
