"""Compares a registered query with its SQL on the same tables."""

import glob
import math
import os


def connect(d: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


def differences(spark, c, query, sql: str, d: str) -> list:
    df = query(spark, d)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(k)]) for k in columns) for r in got.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    return [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
