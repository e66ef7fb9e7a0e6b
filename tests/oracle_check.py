"""Compare registered queries with their SQL twins on the same tables.

Usage: python tests/oracle_check.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "item"):
        v = v.item()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def first_difference(a, b):
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    if len(a[1]) != len(b[1]):
        extra = [x for x in a[1] if x not in set(b[1])][:2], [x for x in b[1] if x not in set(a[1])][:2]
        return f"rows {len(a[1])} / {len(b[1])}: {str(extra)[:1500]}"
    for x, y in zip(a[1], b[1]):
        if x != y or [type(i) for i in x] != [type(i) for i in y]:
            return f"{str(x)[:700]} / {str(y)[:700]}"
    return None


def main():
    import __spark_entry__ as entry
    from veilspark.plans.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            t = time.time()
            got = spark_rows(fn(spark, sf))
            t1 = time.time() - t
            if name not in oracle:
                print(f"{name:36s} rows only {len(got[1])}  {t1:.1f}s", flush=True)
                continue
            t = time.time()
            want = duck_rows(con, oracle[name])
            diff = first_difference(got, want)
            print(f"{name:36s} {'ok' if diff is None else 'DIFF'} {len(got[1])}  {t1:.1f}s / {time.time() - t:.1f}s", flush=True)
            if diff:
                bad += 1
                print("    ", diff)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:36s} ERROR {type(e).__name__} {str(e)[:1200]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
