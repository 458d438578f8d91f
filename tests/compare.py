"""Run registered queries next to their SQL: python tests/compare.py [--sf DIR] [NAME ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "asDict"):
        return norm(tuple(v.asDict().values()))
    if isinstance(v, dict):
        return norm(tuple(v.values()))
    if type(v).__name__ == "Decimal":
        return norm(float(v))
    if isinstance(v, bool) or v is None:
        return v
    return v


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in data)


def check(spark, con, name, query, sql, sf):
    began = time.time()
    df = query(spark, sf)
    got = df.collect()
    took = time.time() - began
    if sql is None:
        return f"rows only: {len(got)} ({took:.1f} s)", True
    cur = con.execute(sql)
    a, b = rows_of(df.columns, got), rows_of([c[0] for c in cur.description], cur.fetchall())
    if a == b:
        return f"ok: {len(got)} rows ({took:.1f} s)", True
    return f"DIFFERS: columns {a[0]} {b[0]}; {len(got)} and {sum(b[1].values())} rows; only Spark {list((a[1] - b[1]).items())[:2]}; only SQL {list((b[1] - a[1]).items())[:2]}", False


def main(args):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql, bad = duck(sf), e.queries(), e.oracle_sql(), 0
    for name in args or queries:
        try:
            said, good = check(spark, con, name, queries[name], sql.get(name), sf)
        except Exception:
            said, good = "FAILED " + traceback.format_exc()[-1500:], False
        bad += not good
        print(name, said, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
