"""Operator 13 against exact fractions and numpy, and edge cases."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import registry, whitening

ROWS = "vec_id long, embedding array<float>, label int, n long, whitened string"


def whole(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def brute(vectors):
    """n, deviations, V (rounded from exact fractions), its trace."""
    x = [whole(v) for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dims)]
    y = [[n * r[j] - s[j] for j in range(dims)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(dims)] for i in range(dims)])
    return n, [sum(c * c for c in r) for r in y], v, np.array(y, float) / n


def check(found, ids, vectors, components=32):
    n, deviations, v, centred = brute(vectors)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    assert len(found) == n * len(values) and {r.n for r in found} == {n}
    assert Counter((r.vec_id, r.deviation) for r in found if r.component == 1) == Counter(zip(ids, deviations))
    z = np.zeros((n, len(values)))
    place = {i: at for at, i in enumerate(ids)}
    for r in found:
        z[place[r.vec_id], r.component - 1] = r.whitened
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9)
    want = centred @ axes / np.sqrt(values)
    sign = np.sign((z * want).sum(axis=0))
    assert np.abs(z * sign - want).max() < 1e-7
    zc = z - z.mean(axis=0)
    error = np.abs(zc.T @ zc / n - np.eye(len(values))).max()
    (told,) = {r.identity_error for r in found}
    assert told <= 1e-9 and error <= 1e-9


def test_the_query(spark):
    rows = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pylist()
    found = registry.QUERIES["op13_whiten_embeddings"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=5).tolist()) for i in range(200)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 5), (903, [float("-inf")] * 5), (904, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in good + bad], ROWS).repartition(7)
    check(whitening.whiten(df).collect(), [i for i, _ in good], [v for _, v in good])
    check(whitening.whiten(df, 2).collect(), [i for i, _ in good], [v for _, v in good], 2)


def test_repeated_rows_count_each_time_and_ids_may_be_null(spark):
    rng = np.random.default_rng(2)
    vectors = [[1.0, 2.0, 3.0]] * 40 + rng.normal(size=(60, 3)).tolist()
    found = whitening.whiten(spark.createDataFrame([(None if i == 99 else 7 if i < 40 else i, v, 1, 2, "x") for i, v in enumerate(vectors)], ROWS)).collect()
    n, deviations, _, _ = brute(vectors)
    assert len(found) == 300 and Counter(r.deviation for r in found if r.component == 1) == Counter(deviations)
    assert {r.n for r in found} == {100} and {r.identity_error < 1e-9 for r in found} == {True} and sum(r.vec_id is None for r in found) == 3


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_without_variance(spark, vectors):
    found = whitening.whiten(spark.createDataFrame([(i, v, 1, 2, "x") for i, v in enumerate(vectors)], ROWS)).collect()
    assert len(found) == 2 * len(vectors) and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(0, None, None, None)}


def test_fewer_rows_than_dimensions_lengths_and_large_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(4)] + [(10 + i, [float(i), 3e30 if i == 2 else 1.0]) for i in range(5)]
    found = whitening.whiten(spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], ROWS)).collect()
    short = [r for r in found if r.vec_id < 10]
    assert len(short) == 24 and {r.component for r in short if r.whitened is not None} == {1, 2, 3} and {r.n for r in short} == {4}
    assert len([r for r in found if r.vec_id >= 10]) == 10 and max(r.deviation for r in found) == 2**63 - 1


def test_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], ROWS)).collect() == []


def test_residues_give_the_exact_number():
    rng = np.random.default_rng(4)
    for _ in range(50):
        bound = 10 ** int(rng.integers(1, 60))
        moduli = primes = whitening.primes(2 * bound + 1)
        assert len(set(primes)) == len(primes) and all(p < 1 << 20 for p in primes)
        for number in (bound, -bound, 0, -1, int(rng.integers(1, 1 << 60)) % bound):
            assert whitening.combined([number % p for p in moduli], moduli) == number


def test_scatter_is_exact_where_sums_of_doubles_are_not(spark):
    vectors = [[i % 3 * 1e6, (i % 5) * 1e-2, 1e15] for i in range(1000)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in enumerate(vectors)], ROWS)
    s = whitening.sums(df)
    x = [whole(v) for v in vectors]
    assert s.sums == [sum(r[j] for r in x) for j in range(3)]
    y = [[1000 * r[j] - s.sums[j] for j in range(3)] for r in x]
    assert whitening.scatter(df, s) == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
