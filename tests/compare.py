"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

import glob
import math
import os
from datetime import datetime

import duckdb


def connection(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return float(x) if type(x).__name__ == "Decimal" else x


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)


def rows_of_sql(con, sql):
    r = con.sql(sql)
    names = sorted(r.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    return names, sorted((tuple(plain(v) for v in row) for row in r.select(quoted).fetchall()), key=repr)
