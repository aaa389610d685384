"""Scores of all pairs are formed in pieces of bounded size, and each comes out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, timeline


@pytest.mark.parametrize("shape", [(10_000, 10_000), (4096, 16_384), (3, 5), (2, retrieval.MAX_SCORES * 2)])
def test_tiles_are_bounded_and_cover_all(shape):
    parts = list(retrieval.tiles(*shape))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(shape[0]))
    assert all((p.stop - p.start) * shape[1] <= retrieval.MAX_SCORES or p.stop - p.start == 1 for p in parts)
    assert np.prod(retrieval.WHOLE_BLOCK) <= retrieval.MAX_SCORES


@pytest.mark.parametrize("way", [retrieval._scored, retrieval._dealt])
def test_all_scores_over_several_pieces(spark, way):
    side = lambda n, a, b: spark.range(n).repartition(1).select(F.col("id").alias(a), F.array(F.col("id") % 97 - 48.0, F.col("id") % 31 * 1.0).alias(b))
    found = way(side(9000, "asset_id", "vector"), side(1100, "query_id", "q"), None)
    i, j = np.arange(1100)[:, None], np.arange(9000)
    wrong = F.col("raw_score") != (F.col("query_id") % 97 - 48.0) * (F.col("asset_id") % 97 - 48.0) + (F.col("query_id") % 31) * (F.col("asset_id") % 31)
    r = found.agg(F.count(F.lit(1)).alias("n"), F.sum("raw_score").alias("s"), F.sum(wrong.cast("int")).alias("wrong")).first()
    assert (r.n, r.s, r.wrong) == (1100 * 9000, float(((i % 97 - 48) * (j % 97 - 48) + (i % 31) * (j % 31)).sum()), 0)


def test_representativeness_by_blocks(spark):
    """Equal vectors, vectors of other lengths, equal ids in two videos and a video without chosen frames."""
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.6, 0.8]), ("a", 3, [1.0]), ("a", 4, [1.0, 0.0]), ("b", 1, [-1.0, 0.0]), ("b", 2, [1.0, 0.0]), ("c", 9, [1.0, 0.0])]
    frames = spark.createDataFrame(rows, "v string, f int, x array<float>")
    found = timeline.representativeness(frames, frames.filter("(v = 'a' AND f IN (1, 4)) OR (v = 'b' AND f = 1)"), ["v"], "f", "x")
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "FlatMapCoGroupsInPandas" in plan
    got = {r.v: (r.frames, r.representativeness) for r in found.collect()}
    assert got == {"a": (4, pytest.approx((2 + np.exp(-0.4) + np.exp(-1)) / 4)), "b": (2, pytest.approx((1 + np.exp(-2)) / 2))}
