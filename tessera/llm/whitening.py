"""Embedding whitening (operator 13): exact scatter by residues, then a double-precision eigendecomposition.

Vectors become whole numbers x with a large offset, so a covariance from sums of doubles would lose most of its digits. Here it
loses none: with n rows and sums S, y = n * x - S is a whole number without a mean; every partition multiplies y' y modulo
several primes, small enough for a double-precision matrix product to be exact; Spark adds the residues up over the
partitions; and the driver puts them together (Chinese remaindering) to the exact scatter, of which V = scatter / n**3 is the
correctly rounded covariance. The primes are as many as the scatter's bound needs, which follows from n and from the sums'
and components' ranges. eigh of V gives the components.

What goes to the driver is of the size of the covariance: residues of dims x dims numbers, which a task and the driver must be
able to hold (dims of some thousands). Passes: counts and sums, residues, and one that measures the covariance of what comes
out. Each streams over the rows in batches and shuffles sums only.

Edge cases: vectors that are null or hold null or non-finite components take no part; repeated rows and rows without a vec_id
are rows like any other; vectors of each length are a fit list of their own, empty ones give no rows; where there are fewer
than 32 dimensions there are as many components; a component without variance (its eigenvalue is nothing but rounding: one row,
equal rows, fewer rows than dimensions) has a null `whitened` and isn't counted in identity_error, which is null if there is no other, as is `explained` if the
trace is 0; numbers beyond +-2**61 become the nearest of these; a deviation that a long can't hold becomes the largest long;
further columns, whatever their names, are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.kdtree import usable

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Residues lie below 2 ** 20 and are multiplied in pieces of so many rows, so sums of products stay exact in doubles (2 ** 53).
PRIME_BITS = 20
PIECE = 1 << 13
_LIMIT = 1 << 61
_LONG_MAX = (1 << 63) - 1
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def primes(bound: int) -> list[int]:
    """The largest primes below 2 ** PRIME_BITS, as many as it takes for their product to be over bound."""
    out, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound:
        if all(p % f for f in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def combined(residues: list[int], moduli: list[int]) -> int:
    """The number of least absolute value with these residues."""
    out, product = 0, 1
    for r, p in zip(residues, moduli):
        out += product * ((int(r) - out) * pow(product, -1, p) % p)
        product *= p
    return out - product if out * 2 > product else out


def whole(embeddings: pd.Series) -> np.ndarray:
    """floor(64 * c) + 1000000 of every component (rows x dims, int64)."""
    x = np.floor(np.stack(embeddings.to_numpy()).astype(np.float64) * SCALE)
    return np.clip(x, -float(_LIMIT), float(_LIMIT)).astype(np.int64) + OFFSET


def _exact_sum(x: np.ndarray) -> list[int]:
    """Sums by column, of any size."""
    high, low = (x >> 31).sum(axis=0), (x & ((1 << 31) - 1)).sum(axis=0)
    return [(int(a) << 31) + int(b) for a, b in zip(high, low)]


@dataclass
class Sums:
    """n, and of each dimension its sum, least and largest number."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]

    @property
    def reach(self) -> int:
        """No |n * x - S| is larger."""
        return max(max(self.n * h - s, s - self.n * v) for s, v, h in zip(self.sums, self.low, self.high))


def sums(rows: DataFrame) -> Sums:
    """rows: embeddings of one length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, low, high = 0, None, None, None
        for b in batches:
            if len(b):
                x = whole(b["embedding"])
                part = _exact_sum(x)
                total = part if total is None else [a + c for a, c in zip(total, part)]
                low, high = (x.min(axis=0), x.max(axis=0)) if low is None else (np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)))
                n += len(b)
        if n:
            yield pd.DataFrame({"dim": range(len(total)), "n": n, "total": [str(t) for t in total], "low": low, "high": high})

    parts = rows.select("embedding").mapInPandas(run, "dim int, n long, total string, low long, high long")
    of = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    got = sorted(of.collect(), key=lambda r: r["dim"])  # a row a dimension
    return Sums(got[0]["n"], [int(r["total"]) for r in got], [r["low"] for r in got], [r["high"] for r in got])


def _centred(x: np.ndarray, s: Sums, modulus: int) -> np.ndarray:
    """(n * x - S) modulo a prime, as doubles."""
    shift = np.array([v % modulus for v in s.sums], np.int64)
    return (((x % modulus) * (s.n % modulus) - shift) % modulus).astype(np.float64)


def scatter(rows: DataFrame, s: Sums) -> list[list[int]]:
    """The exact sum of y' y over the rows, y = n * x - S."""
    moduli = primes(2 * s.n * s.reach**2 + 1)
    dims = len(s.sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, some = np.zeros((len(moduli), dims, dims), np.int64), False
        for b in batches:
            for a in range(0, len(b), PIECE):
                x, some = whole(b["embedding"].iloc[a : a + PIECE]), True
                for i, p in enumerate(moduli):
                    y = _centred(x, s, p)
                    total[i] = (total[i] + (y.T @ y).astype(np.int64)) % p
        if some:
            for i, t in enumerate(total):
                yield pd.DataFrame({"prime": i, "row": range(dims), "residues": t.tolist()})

    parts = rows.select("embedding").mapInPandas(run, "prime int, row int, residues array<long>")
    each = parts.select("prime", "row", F.posexplode("residues").alias("col", "r")).groupBy("prime", "row", "col").agg(F.sum("r").alias("r"))
    lines = each.groupBy("prime", "row").agg(F.array_sort(F.collect_list(F.struct("col", "r"))).alias("c")).select("prime", "row", F.transform("c", lambda c: c["r"]).alias("r"))
    residues = np.zeros((len(moduli), dims, dims), np.int64)
    for r in lines.toLocalIterator():  # primes x dims rows
        residues[r["prime"], r["row"]] = np.array(r["r"]) % moduli[r["prime"]]
    return [[combined(residues[:, i, j].tolist(), moduli) for j in range(dims)] for i in range(dims)]


@dataclass
class Whitening:
    """Of a fit list: its sums, eigenvalues in falling order, the components' vectors (dims x components) and the trace of V."""

    s: Sums
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def defined(self) -> np.ndarray:
        """Components with variance: eigenvalues that are more than rounding."""
        rounding = len(self.s.sums) * np.finfo(np.float64).eps * max(self.trace, 0.0)
        return (self.values > rounding) & (np.arange(1, len(self.values) + 1) < self.s.n)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x - S / n, correct but for one rounding or two, and each row's exact sum of (n * x - S) ** 2."""
        n = self.s.n
        if self.s.reach**2 * max(len(self.s.sums), 1) <= _LONG_MAX and n * (max(map(abs, self.s.low + self.s.high)) + 1) <= _LONG_MAX:
            y = x * n - np.array(self.s.sums, np.int64)
            return y / n, (y * y).sum(axis=1).tolist()
        wide = [[int(c) * n - t for c, t in zip(row, self.s.sums)] for row in x.tolist()]
        return np.array([[c / n for c in row] for row in wide]), [min(sum(c * c for c in row), _LONG_MAX) for row in wide]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows x components; NaN without variance."""
        scale = np.where(self.defined, np.sqrt(np.where(self.defined, self.values, 1.0)), np.nan)
        return centred @ self.axes / scale


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """rows: embeddings of one length, one at least."""
    s = sums(rows)
    exact, cube = scatter(rows, s), s.n**3
    v = np.array([[c / cube for c in row] for row in exact])  # whole numbers of any size, divided with one rounding
    values, axes = np.linalg.eigh(v)
    falling = np.argsort(-values, kind="stable")[:components]
    return Whitening(s, values[falling], axes[:, falling], sum(exact[i][i] for i in range(len(exact))) / cube)


def identity_error(rows: DataFrame, w: Whitening) -> float | None:
    """The largest absolute entry of (covariance of what comes out) - identity, measured over all rows."""
    use = np.flatnonzero(w.defined)
    if not use.size:
        return None
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second, some = np.zeros(len(use)), np.zeros((len(use), len(use))), False
        for b in batches:
            if len(b):
                # Already without a mean but for rounding; what is left of it is taken out below.
                z, some = shared.value.whitened(shared.value.centred(whole(b["embedding"]))[0])[:, use], True
                first, second = first + z.sum(axis=0), second + z.T @ z
        if some:
            yield pd.DataFrame({"row": range(len(use)), "mean": first, "line": second.tolist()})

    parts = rows.select("embedding").mapInPandas(run, "row int, mean double, line array<double>")
    each = parts.select("row", "mean", F.posexplode("line").alias("col", "z")).groupBy("row", "col").agg(F.sum("z").alias("z"), F.sum("mean").alias("mean"))
    mean, second = np.zeros(len(use)), np.zeros((len(use), len(use)))
    for r in each.collect():  # components ** 2 rows
        second[r["row"], r["col"]] = r["z"] / w.s.n
        mean[r["row"]] = r["mean"] / w.s.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(len(use))).max())


def applied(rows: DataFrame, w: Whitening, error: float | None) -> DataFrame:
    """A row for each of the rows (vec_id, embedding) and component."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), PIECE):
                b, w = batch.iloc[a : a + PIECE], shared.value
                centred, deviation = w.centred(whole(b["embedding"]))
                z, m = w.whitened(centred), len(w.values)
                share = w.values / w.trace if w.trace > 0 else np.full(m, np.nan)
                out = {"vec_id": b["vec_id"].astype("Int64").repeat(m).array, "component": np.tile(np.arange(1, m + 1), len(b)), "n": w.s.n, "deviation": np.repeat(np.array(deviation, np.int64), m)}
                yield pd.DataFrame(out | {"whitened": z.ravel(), "explained": np.tile(share, len(b)), "identity_error": error if error is not None else np.nan})

    out = rows.select(F.col("vec_id").cast("long"), "embedding").mapInPandas(run, _OUT)
    defined = lambda c: F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(F.col(c)).alias(c)
    return out.select("vec_id", "component", "n", "deviation", *[defined(c) for c in ("whitened", "explained", "identity_error")])


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: every remaining row in the components of its fit list."""
    good = written(rows.select("vec_id", "embedding").filter(usable(F.col("embedding")) & (F.size("embedding") > 0)), "remaining")
    out = rows.sparkSession.createDataFrame([], _OUT)
    for r in good.groupBy(F.size("embedding").alias("length")).count().orderBy("length").collect():  # lengths of vectors: few
        own = good.filter(F.size("embedding") == r["length"])
        w = fitted(own, components)
        out = out.unionAll(applied(own, w, identity_error(own, w)))
    return out


def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over all embeddings: up to 32 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
