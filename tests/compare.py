"""Runs registered queries against their SQL in DuckDB: python tests/compare.py SF NAME..."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session():
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return norm(list(v.asDict().values()))
    if isinstance(v, dict):
        return norm(list(v.values()))
    return str(v)


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, name: str, folder: str) -> str:
    t = time.time()
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(mine)} rows {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"COLUMNS differ: {cols} {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    if mine == theirs:
        return f"ok {len(mine)} rows {took:.1f}s"
    here, there = set(mine), set(theirs)
    a, b = sorted(here - there), sorted(there - here)
    return f"DIFFER {len(mine)} {len(theirs)} only-here {len(a)} {a[:3]} only-there {len(b)} {b[:3]}"


if __name__ == "__main__":
    sf, names = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark, con = session(), duck(folder)
    spark.sparkContext.setLogLevel("ERROR")
    for name in names or entry.queries():
        try:
            print(name, compare(spark, con, name, folder), flush=True)
        except Exception as e:
            print(name, "ERROR", str(e)[:1200], flush=True)
