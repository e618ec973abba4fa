"""Compare a query with its SQL in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str | bytes):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, int):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(cell(r[k]) for k in order)) for r in rows)


def by_sql(sf, text):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    found = con.execute(text)
    columns = [d[0] for d in found.description]
    return columns, found.fetchall()


def same(spark, sf, function, text):
    frame = function(spark, sf)
    columns, rows = by_sql(sf, text)
    assert sorted(frame.columns) == sorted(columns)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert mine == rows_of(columns, rows)
