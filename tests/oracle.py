"""Run a registered query on Spark and its SQL twin on DuckDB, and compare.

Same gate as the driver: column names, row count and an order-insensitive
comparison of all values. Usable from pytest and as a script:

    python -m tests.oracle /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)  # -0.0 and 0.0 stay distinct, as a value hash may keep them
    if isinstance(v, dict):
        return repr(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN"}


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in records)


def compare(spark, name: str, sf_dir: str, con=None, show: int = 5) -> dict:
    import __spark_entry__ as entry

    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = entry.queries()[name](spark, sf_dir)
    s_cols = sdf.columns
    s_types = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"query": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    sql = entry.oracle_sql().get(name)
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res.update(duck_rows=len(d_rows), duck_sec=round(time.time() - t1, 2))
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"columns differ: {sorted(s_cols)} vs {sorted(d_cols)}"
        return res
    d_types = {c: str(t) for c, t in zip(d_cols, rel.types)}
    if s_types != d_types:
        res["status"] = f"types differ: {s_types} vs {d_types}"
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a == b:
        res["status"] = "match"
    else:
        only_s = list((a - b).elements())[:show]
        only_d = list((b - a).elements())[:show]
        res["status"] = f"values differ ({sum((a - b).values())} spark-only rows)"
        res["spark_only"] = only_s
        res["duck_only"] = only_d
    return res


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from costwise.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    names = sys.argv[2:] or list(entry.queries())
    con = duck(sf)
    for n in names:
        try:
            print(compare(spark, n, sf, con), flush=True)
        except Exception as e:  # report and go on
            print({"query": n, "status": f"error: {type(e).__name__}: {str(e)[:300]}"}, flush=True)
