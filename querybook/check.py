"""Compare registered queries with their SQL in DuckDB: ``python -m querybook.check SF_DIR [prefix…]``."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
import traceback

from panelspark.session import name_shared_folder

from .common import REGISTRY


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return v.item()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf: str, name: str) -> str:
    q = REGISTRY[name]
    df = q.run(spark, sf)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return f"rows-only {len(got)}" if got else "EMPTY"
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = _rows(cols, cur.fetchall())
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    if not got:
        return "EMPTY"
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(y) for y in b]]
    return "ok %d" % len(got) if not bad else f"VALUES {len(bad)}/{len(got)}: {bad[0]}"


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    name_shared_folder(spark)
    return spark


def main(argv):
    from . import load_all

    load_all()
    sf, prefixes = argv[0], argv[1:]
    spark, con = session(), duck(sf)
    bad = 0
    for name in REGISTRY:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            res = compare(spark, con, sf, name)
        except Exception as e:
            res = "FAIL " + (traceback.format_exc()[-1500:] if len(prefixes) else f"{type(e).__name__}: {str(e)[:300]}")
        good = res.startswith(("ok", "rows-only"))
        bad += not good
        print(f"{'  ' if good else '!!'} {name:40s} {time.time() - t:6.2f}s {res}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    from querybook.check import main as run

    run(sys.argv[1:])
