"""Holds a query's rows against its SQL on the same Parquet tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in found)


def differences(spark, name, query, sql, sf_dir):
    got = query(spark, sf_dir)
    told = connect(sf_dir).sql(sql)
    if sorted(got.columns) != sorted(told.columns):
        return f"{name}: columns {sorted(got.columns)} and {sorted(told.columns)}"
    a, b = rows(got.columns, got.collect()), rows(told.columns, told.fetchall())
    if a != b:
        return f"{name}: {sum((a - b).values())} rows too many {list((a - b))[:2]}, {sum((b - a).values())} missing {list((b - a))[:2]}"
    return None
