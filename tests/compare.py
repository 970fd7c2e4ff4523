"""Runs registered queries and their SQL side by side and reports differences.

Usage: python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(d: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return repr(v)
    return str(v) if not isinstance(v, (bool, int)) else str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, name: str, fn, sql: str | None, d: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, d)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(got)} rows {t1 - t0:.2f}s"
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    kinds = {c[0]: str(c[1]) for c in rel.description}
    want = rel.fetchall()
    t2 = time.time()
    gc, gr = rows_of(df.columns, got)
    wc, wr = rows_of(names, want)
    note = f"spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s rows {len(got)}"
    if gc != wc:
        return False, f"columns {set(gc) ^ set(wc)} {note}"
    loose = [c for c, k in df.dtypes if KINDS.get(k, kinds[c]) != kinds[c]]
    if gr != wr:
        left = [r for r in gr if r not in set(wr)][:3]
        right = [r for r in wr if r not in set(gr)][:3]
        return False, f"{note} want {len(want)}\n   cols {gc}\n   spark {left}\n   sql   {right}"
    if loose:
        return False, f"{note} types {[(c, dict(df.dtypes)[c], kinds[c]) for c in loose]}"
    return True, note


if __name__ == "__main__":
    import __spark_entry__ as E

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark, con = session(), database(folder)
    sqls, bad = E.oracle_sql(), []
    for name, fn in E.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "BAD ", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)
