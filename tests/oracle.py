"""Spark rows against DuckDB rows."""

import decimal
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def differences(spark, query, sql, sf_dir=SF):
    """(rows of Spark alone, rows of SQL alone, number of rows), by column name."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted(tuple(_norm(r[n]) for n in names) for r in df.collect())
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    found = con.execute(sql)
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == names
    rows = sorted(tuple(_norm(r[theirs.index(n)]) for n in names) for r in found.fetchall())
    a, b = set(mine), set(rows)
    return [r for r in mine if r not in b], [r for r in rows if r not in a], (len(mine), len(rows))
