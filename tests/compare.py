"""Comparison of a query's rows with those of its SQL."""

import glob
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(df) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr(tuple(plain(row[n]) for n in names)) for row in df.collect())


def sql_rows(folder: str, sql: str) -> list[str]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(plain(row[i]) for i in at)) for row in cursor.fetchall())
