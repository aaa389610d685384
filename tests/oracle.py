"""Runs a query's SQL in DuckDB over the same tables and compares rows."""

import glob
import os

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    return float(v) if hasattr(v, "as_tuple") else v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    """Fails with the first difference."""
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    c = tables(sf_dir)
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = rows(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert a == b
