"""Mixing sources to target weights (operator 1): block quotas by Sainte-Lague, then seeded block selection.

The mix is made of blocks of equal tokens. A block goes to the source with the highest quotient target / (2 k + 1), k being
what it has so far. Because that rule is house-monotone, the seats between two cumulative totals are the integer quotas of one
output shard. Every source's documents lie on a circle in a seeded order, and a seeded place on it is where its walk begins:
shard after shard takes as many further blocks of the walk as its quota says, so a walk that is longer than the circle repeats
it. Blocks are no longer than the smallest target allows, so that small sources come near theirs too.

What a shard takes of a document is the overlap of two stretches of the walk, so nothing enumerates blocks, whatever their
size; quotas come from the divisor form of the rule on one row per source; places come from sums per source and range of the
order, with as many ranges as a source's rows need. Only ids and sizes are sorted; texts are cut where they lie.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, last in order; null and
repeated doc_ids are rows like any other (equal rows are interchangeable); ties of the order go by doc_id, size and digest;
a text of any length is one stretch of the walk; an empty table gives an empty result; further columns are kept by
mixed_documents, whatever their names (but those that begin with two underscores, which are the operator's own).
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import few_rows, table, word_count, written

#: Tokens of a block at most; at least so many blocks go to the source with the smallest target.
BLOCK_TOKENS = 64
LEAST_BLOCKS = 16
N_SHARDS = 16
MAX_REPEAT = 3
SEED = 17
#: Rows, and bytes of text, of a source that one task puts in order.
RANGE_ROWS = 4000
RANGE_BYTES = 64 << 20
#: Plans and the places of ranges are broadcast up to so many rows (about 300 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_ROWS = 100_000
_HASH = 1 << 60


@dataclass(frozen=True)
class SourcePlan:
    """One source's share: the blocks that the mix takes, in all and for each shard, and where its walk begins."""

    source: str | None
    size: int
    target: float
    block: int
    quota: int
    shard_quotas: tuple[int, ...]
    offset: int


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], share: float = 1.0, max_repeat: float = MAX_REPEAT) -> dict[str | None, float]:
    """Target tokens by source: total * share by weight, at most max_repeat times the source, the excess reshared by weight."""
    wanted, out, active = share * sum(sizes.values()), {}, [s for s in sizes if weights[s] > 0]
    while active:
        left, whole = wanted - sum(out.values()), sum(weights[s] for s in active)
        given = {s: left * weights[s] / whole for s in active}
        full = [s for s in active if given[s] > max_repeat * sizes[s]]
        if not full:
            out.update(given)
            break
        out.update({s: float(max_repeat * sizes[s]) for s in full})
        active = [s for s in active if s not in full]
    return {s: out.get(s, 0.0) for s in sizes}


def sainte_lague(target: list[float], most: list[int], seats: int) -> list[int]:
    """Seats by highest quotient target / (2 k + 1); ties go to the earlier one; none gets more than its most.

    All quotients above a safe divisor are counted at once, so only about one seat per party is dealt singly.
    """
    total, m = sum(target), len(target)
    x = max(0.0, (seats - m / 2) / total) if total else 0.0
    got = [min(cap, int(t * x + 0.5)) for t, cap in zip(target, most)]
    heap = [(-t / (2 * k + 1), i) for i, (t, k) in enumerate(zip(target, got)) if t > 0 and k < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-target[i] / (2 * got[i] + 1), i))
    return got


def default_weights(sources: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    ordered = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: float(i % 3 + 1) for i, s in enumerate(ordered)}


def block_size(goals: list[float], most: int = BLOCK_TOKENS) -> int:
    """Tokens of a block: at most so many, and a LEAST_BLOCKS-th of the smallest target."""
    wanted = [g for g in goals if g > 0]
    return max(1, min([most, *(int(g // LEAST_BLOCKS) for g in wanted)]))


def plan_mixture(sizes: dict[str | None, int], weights: dict[str | None, float] | None = None, *, share: float = 1.0, max_repeat: int = MAX_REPEAT, block_tokens: int = BLOCK_TOKENS, n_shards: int = N_SHARDS, seed: int = SEED) -> list[SourcePlan]:
    """Quotas for all sources, in order of the source. Only the sources' sizes are needed, so this runs on the driver."""
    weights = weights or default_weights(list(sizes))
    ordered = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    goal = targets({s: sizes[s] for s in ordered}, weights, share, max_repeat)
    want = [goal[s] for s in ordered]
    block = block_size(want, block_tokens)
    most = [max_repeat * sizes[s] // block for s in ordered]
    seats = int(sum(want) / block + 0.5)
    upto = [[0] * len(ordered), *(sainte_lague(want, most, seats * k // n_shards) for k in range(1, n_shards + 1))]
    plans = []
    for i, s in enumerate(ordered):
        start = int(hashlib.md5(f"{seed}:{'n' if s is None else 's' + s}".encode()).hexdigest()[:8], 16) % max(1, sizes[s])
        plans.append(SourcePlan(s, sizes[s], goal[s], block, upto[-1][i], tuple(b[i] - a[i] for a, b in zip(upto, upto[1:])), start))
    return plans


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds __size, __key (the source, null-safe), __hash (60 bits, seeded) and __digest to docs."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.lit(":"), F.col("__size").cast("string"))
    hashed = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")
    return docs.withColumn("__size", word_count(F.col("text"))).withColumn("__key", key).withColumn("__hash", hashed).withColumn("__digest", F.xxhash64("text"))


def _planned(narrow: DataFrame, seed: int, plan: dict) -> tuple[DataFrame, DataFrame]:
    """Per source the plan's figures; per source and range of its order where the range begins. Both are broadcast if small."""
    by_source = narrow.groupBy("__key").agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("n"), F.sum("__bytes").alias("b")).collect()  # a row a source
    ranges = {r["__key"]: max(-(-r["n"] // RANGE_ROWS), -(-r["b"] // RANGE_BYTES), 1) for r in by_source}
    plans = plan_mixture({None if r["__key"] == "n" else r["__key"][1:]: int(r["size"]) for r in by_source}, seed=seed, **plan)
    rows = []
    for p in plans:
        key, upto = "n" if p.source is None else f"s{p.source}", [0]
        for q in p.shard_quotas:
            upto.append(upto[-1] + q * p.block)
        rows.append((key, p.size, p.target, upto, p.offset, ranges[key]))
    schema = [("__key", pa.string()), ("__source_size", pa.int64()), ("__target", pa.float64()), ("__upto", pa.list_(pa.int64())), ("__offset", pa.int64()), ("__ranges", pa.int64())]
    known = few_rows(narrow.sparkSession, rows, pa.schema(schema))
    small = sum(ranges.values()) <= MAX_BROADCAST_ROWS
    known = F.broadcast(known) if small else known
    sums = _ranged(narrow.select("__key", "__hash", "__size"), known).groupBy("__key", "__range").agg(F.sum("__size").alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy("__key").orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select("__key", "__range", F.coalesce(before, F.lit(0)).alias("__before"))
    return known, F.broadcast(starts) if small else starts


def _ranged(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known, "__key").withColumn("__range", F.floor(F.col("__hash") / (F.lit(float(_HASH)) / F.col("__ranges"))))


def _placed(rows: DataFrame, known: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds the source's plan and __first: where the row's tokens begin on its source's circle."""
    w = W.partitionBy("__key", "__range").orderBy("__hash", "doc_id", "__size", "__digest")
    rows = _ranged(rows, known).withColumn("__last", F.sum("__size").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.join(starts, ["__key", "__range"]).withColumn("__first", F.col("__last") + F.col("__before") - F.col("__size"))


def _stretches() -> list[tuple[Column, Column]]:
    """The row's two stretches [from, to) of one round of the walk.

    The second is empty but where the walk begins inside the row: then it is the row's beginning, which comes last.
    """
    size = F.col("__source_size")
    begin = F.col("__first") - F.col("__offset")
    end = begin + F.col("__size")
    inside = (begin < 0) & (end > 0)
    low = F.when(begin >= 0, begin).when(inside, F.lit(0)).otherwise(begin + size)
    high = F.when((begin >= 0) | inside, end).otherwise(end + size)
    return [(low, high), (F.when(inside, begin + size).otherwise(F.lit(0)), F.when(inside, size).otherwise(F.lit(0)))]


def _within(low: Column, high: Column, rest: Column) -> Column:
    """How much of a stretch lies among the first tokens of a round."""
    return F.greatest(F.lit(0), F.least(high, rest) - low)


def _taken_before(tokens: Column) -> Column:
    """Words of the row among the first so many tokens of its source's walk."""
    rounds = F.floor(tokens / F.col("__source_size"))
    rest = tokens - rounds * F.col("__source_size")
    (a, b), (c, d) = _stretches()
    return F.when(F.col("__size") > 0, rounds * F.col("__size") + _within(a, b, rest) + _within(c, d, rest)).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, *, seed: int = SEED, **plan) -> DataFrame:
    """What the mix takes of every row: doc_id, source, size, source_size, target, taken (words, repeats counted), shard_taken.

    shard_taken: the words that each of the mix's shards takes, comma-joined.
    """
    rows = _keyed(docs.select("doc_id", "text", "source"), seed).drop("text")
    rows = written(rows.withColumn("__bytes", F.lit(0)), "mix")  # texts are read once and not moved
    known, starts = _planned(rows, seed, plan)
    placed = _placed(rows, known, starts).withColumn("__taken", F.transform("__upto", _taken_before))
    by_shard = F.transform(F.sequence(F.lit(1), F.size("__taken") - 1), lambda i: (F.get("__taken", i) - F.get("__taken", i - 1)).cast("string"))
    return placed.select("doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.element_at("__taken", -1).alias("taken"), F.array_join(by_shard, ",").alias("shard_taken"))


def mixed_documents(docs: DataFrame, *, seed: int = SEED, **plan) -> DataFrame:
    """The mix itself: docs' columns, a row for each round of the walk that takes any of a document.

    A round that takes all of a document keeps its text as it is. Only where a source's walk begins and where it ends a
    document is taken in part; then its text is the words of that part, with the white space between them, two parts being
    joined by a line break. n_chars, where it is a column, follows. Texts move once, to their range of their source's order.
    """
    keyed = _keyed(docs, seed)
    sizes = keyed.select("__key", "__hash", "__size", F.coalesce(F.octet_length("text"), F.lit(0)).alias("__bytes"))
    known, starts = _planned(written(sizes, "mix-sizes"), seed, plan)
    placed = _placed(keyed, known, starts)
    total, size = F.element_at("__upto", -1), F.col("__source_size")
    placed = placed.filter((F.col("__size") > 0) & (total > 0)).withColumn("__round", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / size))))
    rest = F.least(size, total - F.col("__round") * size)
    (a, b), (c, d) = _stretches()
    placed = placed.withColumn("__tail", _within(a, b, rest).cast("int")).withColumn("__head", _within(c, d, rest).cast("int")).withColumn("__skip", (d - c).cast("int"))
    placed = placed.filter(F.col("__tail") + F.col("__head") > 0)
    whole = F.col("__tail") + F.col("__head") == F.col("__size")
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    part = lambda at, n: F.regexp_replace(F.array_join(F.slice("__words", at + 1, n), ""), r"^[\x20\x09-\x0D]+", "")
    cut = F.when(F.col("__head") == 0, part(F.col("__skip"), F.col("__tail"))).when(F.col("__tail") == 0, part(F.lit(0), F.col("__head")))
    cut = cut.otherwise(F.concat(part(F.lit(0), F.col("__head")), F.lit("\n"), part(F.col("__skip"), F.col("__tail"))))
    out = placed.withColumn("__words", F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents: 100 % of all words, sources weighing 1, 2, 3, repeating."""
    return mix(table(spark, sf_dir, "documents"))


#: Quotients are dealt one by one here, seats by rank, and words walked one by one; the operator counts both in closed form.
OP1_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
hashed AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'n') || ':' || size::VARCHAR), 1, 15))::BIGINT AS h FROM sized),
src AS (
  SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM src),
filled AS (
  SELECT 0 AS step, k, source, source_size, w, i, NULL::DOUBLE AS fixed FROM weighted
  UNION ALL
  SELECT step + 1, k, source, source_size, w, i,
    CASE WHEN fixed IS NOT NULL THEN fixed
         WHEN (sum(source_size) OVER () - coalesce(sum(fixed) OVER (), 0)) * w / sum(CASE WHEN fixed IS NULL THEN w END) OVER () > {MAX_REPEAT} * source_size
         THEN {MAX_REPEAT}.0 * source_size END
  FROM filled WHERE step < 30),
goal AS (
  SELECT k, source, source_size, i, coalesce(fixed, (sum(source_size) OVER () - coalesce(sum(fixed) OVER (), 0)) * w / sum(CASE WHEN fixed IS NULL THEN w END) OVER ()) AS target
  FROM filled WHERE step = 30),
sizes AS (SELECT greatest(1, least({BLOCK_TOKENS}, min(floor(target / {LEAST_BLOCKS})) FILTER (target > 0)))::BIGINT AS block, sum(target) AS whole FROM goal),
blocks AS (SELECT goal.*, block, floor(whole / block + 0.5)::BIGINT AS seats FROM goal, sizes),
quotients AS (
  SELECT k, seats, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, i) AS place
  FROM blocks, unnest(range(0, least({MAX_REPEAT} * source_size // block, (target / block)::BIGINT + 20))) AS t(j) WHERE target > 0),
quotas AS (SELECT k, s, count(q.k) AS q FROM (SELECT k, seats, s FROM blocks, unnest(range(0, {N_SHARDS + 1})) AS t(s)) b LEFT JOIN quotients q USING (k) WHERE q.k IS NULL OR place <= b.seats * s // {N_SHARDS} GROUP BY k, s),
plan AS (
  SELECT b.*, list_transform(range(0, {N_SHARDS + 1}), lambda s: coalesce(m[s], 0) * block) AS upto,
         ('0x' || substr(md5('{SEED}:' || b.k), 1, 8))::BIGINT % greatest(source_size, 1) AS off
  FROM blocks b LEFT JOIN (SELECT k, map(list(s), list(q)) AS m FROM quotas GROUP BY k) USING (k)),
placed AS (
  SELECT doc_id, k, size, row_number() OVER () AS r,
         sum(size) OVER (PARTITION BY k ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS b0 FROM hashed),
walked AS (
  SELECT r, len(list_filter(upto, lambda u: u <= d)) AS shard FROM (
    SELECT r, upto, (x - off + source_size) % source_size + p * source_size AS d
    FROM placed JOIN plan USING (k), unnest(range(b0::BIGINT, (b0 + size)::BIGINT)) AS t(x), unnest(range(0, {MAX_REPEAT + 1})) AS v(p))
  WHERE d < upto[{N_SHARDS + 1}]),
counted AS (SELECT r, shard, count(*)::BIGINT AS n FROM walked GROUP BY ALL),
pieces AS (SELECT r, sum(n)::BIGINT AS taken, map(list(shard), list(n)) AS m FROM counted GROUP BY r)
SELECT doc_id, g.source AS source, size, g.source_size AS source_size, target, coalesce(taken, 0)::BIGINT AS taken,
       array_to_string(list_transform(range(1, {N_SHARDS + 1}), lambda s: coalesce(m[s], 0)), ',') AS shard_taken
FROM placed p JOIN plan g USING (k) LEFT JOIN pieces USING (r)
"""
