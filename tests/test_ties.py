"""Frames of one second: the order of time leaves theirs open, so it is that of their ids, however the table lies in files.

DuckDB's own order of ties isn't fixed, so the SQL is run here with ids behind its times.
"""

import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera import registry
from tests.oracle import same

registry.load()


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Events of which 24 share a second: a folder for SQL with one file in their order, and one for Spark in many files of other orders."""
    folder = tmp_path_factory.mktemp("tied")
    # One boundary at most of each user (a value over 50) in a second, before or amid the others.
    rows = [(i, 1_700_000_000_000_000 + i // 24 * 7_200_000_000 + i, i % 3, "view", 60.0 + i % 7 if i % 24 // 3 == (None, 0, 3)[i // 24 % 3] else float(i * 37 % 50), "{}") for i in range(240)]
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    table = pa.table({n: pa.array(c, pa.timestamp("us") if n == "ts" else None) for n, c in zip(names, zip(*rows))})
    for d in ("sql", "spark/events.parquet"):
        os.makedirs(folder / d)
    pq.write_table(table, folder / "sql/events.parquet")
    for i in range(0, 240, 8):
        pq.write_table(table.slice(i, 8), folder / f"spark/events.parquet/{240 - i:03}.parquet")
    return str(folder / "sql"), str(folder / "spark")


@pytest.mark.parametrize("name", ["video_scenes", "merged_scenes", "scene_hierarchy", "track_displacement", "keyframe_budget"])
def test_ties_by_id(spark, tied, name):
    ordered, files = tied
    sql = re.sub(r"(ORDER BY (score DESC, )?t)\b", r"\1, frame", registry.ORACLES[name])
    sql = re.sub(r"arg_(min|max)\((\w), t\)", lambda m: f"arg_min({m[2]}, ({'-' * (m[1] == 'max')}t, frame))", sql)
    same(registry.QUERIES[name](spark, files), sql, ordered)
