"""Run queries next to their SQL in DuckDB and compare as the driver does."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cpus: int = 8, **conf):
    from pyspark.sql import SparkSession
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("tidemark-tests")
               .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, query, sql):
    """(ok, text) for one query."""
    started = time.time()
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return False, "the plan has a cross join"
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL, {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return False, f"{len(got)} rows against {len(want)}; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g. {sorted(df.columns)} {bad[:3]}"
    return True, f"{len(got)} rows, {took:.1f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry
    folder = f"{DATA}/{os.environ.get('SF', 'sf0.01')}"
    spark, con = session(), database(folder)
    picked, sqls = entry.queries(), entry.oracle_sql()
    only = [a for a in sys.argv[1:]]
    failed = []
    for name, q in picked.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            ok, text = compare(spark, con, folder, name, q, sqls.get(name))
        except Exception as problem:
            ok, text = False, f"{type(problem).__name__}: {str(problem)[:1500]}"
        if not ok:
            failed.append(name)
        print("ok  " if ok else "FAIL", name, text, flush=True)
    print(len(failed), "failed:", failed)
