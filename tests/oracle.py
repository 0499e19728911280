"""Compare queries with their SQL, as the driver does: python tests/oracle.py DIR [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, query, sql):
    """None if the query's rows are those of the SQL, else what differs."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    relation = con.sql(sql)
    if sorted(relation.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(relation.columns)}"
    want = rows_of(relation.columns, relation.fetchall())
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} and {len(want)} rows; only here {sorted(a)[:2]}, only in SQL {sorted(b)[:2]}"
    kinds = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    odd = [(c, t, kinds[c]) for c, t in df.dtypes if same.get(t) != kinds[c]]
    return f"types {odd}" if odd else None


if __name__ == "__main__":
    os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[1])
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sqls = entry.oracle_sql()
    for name in sys.argv[2:] or sqls:
        try:
            print(name, compare(spark, sys.argv[1], entry.queries()[name], sqls[name]) or "ok", flush=True)
        except Exception as e:
            print(name, "ERROR", str(e).split("JVM stacktrace")[0][:600], traceback.format_exc().splitlines()[-1][:200] if "-v" in sys.argv else "", flush=True)
