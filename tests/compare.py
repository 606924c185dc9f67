"""Compare registered queries with their SQL in DuckDB: python -m tests.compare [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/**/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)) or hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if hasattr(x, "isoformat"):
        return x.isoformat().replace("+00:00", "").removesuffix("T00:00:00")
    return x


def differences(spark: SparkSession, con, run, sql: str, sf_dir: str) -> list[str]:
    df = run(spark, sf_dir)
    got_cols = df.columns
    rel = con.sql(sql)
    want_cols = list(rel.columns)
    if sorted(got_cols) != sorted(want_cols):
        return [f"columns {sorted(got_cols)} and {sorted(want_cols)}"]
    order = sorted(got_cols)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[want_cols.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    out = [] if len(got) == len(want) else [f"{len(got)} and {len(want)} rows"]
    out += [f"{a} and {b}" for a, b in zip(got, want) if a != b][:3]
    return out


def session() -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf)
    queries, oracle = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        at = time.time()
        try:
            found = differences(spark, con, queries[name], oracle[name], sf) if name in oracle else [f"no SQL; {queries[name](spark, sf).count()} rows"]
        except Exception as x:  # noqa: BLE001
            found = [f"{type(x).__name__}: {str(x)[:700]}"]
        bad += bool(found) and name in oracle
        print(name, "ok" if not found else found, f"{time.time() - at:.1f}s", flush=True)
    sys.exit(bad)
