"""Runs registered queries next to their SQL and compares rows: python check.py [sf_dir] [name part...]."""

from __future__ import annotations

import math
import sys
import time
import warnings

warnings.filterwarnings("ignore")

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def normal(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, float) or hasattr(value, "as_tuple"):
        f = float(value)
        return "nan" if math.isnan(f) else f
    return value


def sort_key(row):
    return tuple((v is not None, str(type(v)), str(v)) if not isinstance(v, (int, float)) else (True, "n", f"{float(v):030.8f}") for v in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols, tolerance=0.0):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} != {sorted(duck_cols)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} != {len(duck_rows)}"
    order = sorted(spark_cols)
    a = sorted(([normal(r[spark_cols.index(c)]) for c in order] for r in spark_rows), key=sort_key)
    b = sorted(([normal(r[duck_cols.index(c)]) for c in order] for r in duck_rows), key=sort_key)
    for x, y in zip(a, b):
        if x != y:
            diff = [(c, p, q) for c, p, q in zip(order, x, y) if p != q]
            return f"first difference {diff} in {dict(zip(order, x))}"
    return ""


def main(sf: str, parts: list[str]) -> int:
    import duckdb

    from slopeworks.session import local_session
    from workload import ORACLES, QUERIES

    spark = local_session()
    duck = duckdb.connect()
    duck.execute("SET TimeZone='UTC'")
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = []
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - started
            if name not in ORACLES:
                print(f"rows-only {name}: {len(rows)} rows {took:.1f}s", flush=True)
                continue
            rel = duck.sql(ORACLES[name])
            columns, types = rel.columns, [str(t) for t in rel.types]
            why = compare(rows, df.columns, rel.fetchall(), columns)
            kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
            got = {c: kinds.get(t, t) for c, t in df.dtypes}
            want = dict(zip(columns, types))
            odd = {c: (got[c], want[c]) for c in got if c in want and got[c] != want[c] and not got[c].startswith("array")}
            if odd:
                why = why + f" TYPES {odd}"
        except Exception as e:  # report and go on with the next query
            why, took = f"{type(e).__name__}: {str(e)[:600]}", time.time() - started
        if why:
            bad.append(name)
        print(f"{'DIFF' if why else 'ok  '} {name} {took:.1f}s {len(rows) if not why else ''} {why}", flush=True)
    print("failed:", bad)
    return len(bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(1 if main(args[0] if args else "/root/testdata/sf0.001", args[1:]) else 0)
