"""Rows in one comparable form, and DuckDB over the test tables."""

import math
from pathlib import Path

import duckdb

TINY = "/root/testdata/sf0.001"


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return [value(v) for v in x]
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 6) + 0.0
    return str(x)[:19] if hasattr(x, "isoformat") else x


def rows(records, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([value(r[i]) for i in order]) for r in records)


def same(df, sql, folder=TINY):
    db = duckdb.connect()
    for path in Path(folder).iterdir():
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = db.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), found.columns)
