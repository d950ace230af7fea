"""Compares a registered query with its DuckDB SQL on the same tables."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    if type(x).__name__ == "datetime" and x.tzinfo is not None:
        return x.replace(tzinfo=None)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql, sf_dir):
    found = connect(sf_dir).execute(sql)
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, found.fetchall())
    got = rows_of(df.columns, df.collect())
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)
    return got
