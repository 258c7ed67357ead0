"""DuckDB beside Spark, over a folder of the driver's tables or over given rows."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            path = f"{sf}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{sf}/{t}.parquet") else "")
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def same(df, sql, sf=SF):
    names, want = oracle(sql, sf)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)
    return len(got)


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder
