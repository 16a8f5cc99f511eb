"""Run queries next to their SQL twins and report differences.

    python tools/check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), [cols[i] for i in order]


def compare(spark_df, duck, sql):
    got, gcols = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = duck.execute(sql)
    want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if gcols != wcols:
        return f"columns {gcols} != {wcols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first only-spark {next((r for r in got if r not in want), None)}"
    bad = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g.\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return None


def connect(sf_dir):
    import duckdb

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return duck


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--plain", action="store_true", help="a session with Spark's defaults")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    from siftwork.plans import all_oracles, all_queries
    from siftwork.session import local_session

    if args.plain:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    else:
        spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    duck = connect(sf_dir)
    oracles = all_oracles()
    failed = 0
    for name, fn in all_queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                msg = compare(df, duck, oracles[name])
                n = ""
            else:
                n = f"rows={len(df.collect())}"
                msg = None
        except Exception as e:  # noqa: BLE001
            msg = "".join(traceback.format_exception_only(e))[:900]
            n = ""
        kind = "sql " if name in oracles else "rows"
        print(f"## {'FAIL' if msg else 'ok  '} {kind} {name:38s} {time.time() - t:6.2f}s {n} {msg or ''}", flush=True)
        failed += bool(msg)
    print("## failed:", failed)


if __name__ == "__main__":
    main()
