"""Events from observations: candidates, online assignment, consolidation, re-segmentation, summaries, trips.

An observation is a row of scope_id, obs_id, ts, location, visual_place, kind, activity (strings; null or empty is unknown),
objects and people (arrays), gps (struct<lat, lon> or null) and vector (array or null). What an event is scored by is the union
of its observations' values: a row of scope_id, event_id, start_ts, activity, and arrays locations, visual_places, kinds,
objects, people, spots and vectors.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from heapq import heappop, heappush
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.geo import EARTH_KM, haversine
from tessera.functions.vector import cosine, decay, set_overlap
from tessera.operators.joins import micros, within
from tessera.operators.sequences import sessions

# How much each part of a candidate's score weighs, and what a match of a part is worth.
WEIGHTS = {"time": 0.25, "location": 0.25, "visual_place": 0.15, "kind": 0.05, "activity": 0.20, "objects": 0.05, "people": 0.20, "visual": 0.05, "bonus": 0.20}
MATCH = {"visual_place": 1.0, "kind": 0.8, "activity": 0.9, "objects": 0.8, "people": 0.8}
UNKNOWN_TIME = 0.25
REACH_MINUTES, REACH_KM = 360.0, 2.0
#: Candidates start within six hours and score this at least.
WINDOW_S = 6 * 3600
MINIMUM = 0.50


def event_profiles(observations: DataFrame, event: str = "event_id") -> DataFrame:
    """What each event is scored by: the union of its observations. An event's observations bound the arrays."""
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    each = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return observations.groupBy("scope_id", event).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n"), F.min_by("activity", F.struct("ts", "obs_id")).alias("activity"),
        each("location").alias("locations"), each("visual_place").alias("visual_places"), each("kind").alias("kinds"), merged("objects").alias("objects"), merged("people").alias("people"),
        F.collect_list("gps").alias("spots"), F.collect_list("vector").alias("vectors"),
    )


def _known(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def candidate_parts(o: str, e: str) -> dict[str, Column]:
    """The parts of the score of an observation (columns of alias o) for an event (alias e), each between 0 and 1."""
    c = lambda side, name: F.col(f"{side}.{name}")
    minutes = F.abs(micros(c(o, "ts")) - micros(c(e, "start_ts"))) / 6e7
    near = F.transform(c(e, "spots"), lambda s: F.greatest(F.lit(0.0), 1 - haversine(c(o, "gps")["lat"], c(o, "gps")["lon"], s["lat"], s["lon"]) / REACH_KM))
    by_name = F.when(_known(c(o, "location")) & F.array_contains(c(e, "locations"), c(o, "location")), 1.0).otherwise(0.0)
    a, b = F.lower(c(o, "activity")), F.lower(c(e, "activity"))
    alike = F.array_max(F.transform(F.filter(c(e, "vectors"), lambda v: F.size(v) == F.size(c(o, "vector"))), lambda v: cosine(c(o, "vector"), v)))
    one = lambda hit, name: F.when(F.coalesce(hit, F.lit(False)), MATCH[name]).otherwise(0.0)
    parts = {
        "time": F.coalesce(decay(minutes, REACH_MINUTES), F.lit(UNKNOWN_TIME)),
        "location": F.when(c(o, "gps").isNotNull(), F.coalesce(F.array_max(near), F.lit(0.0))).otherwise(by_name),
        "visual_place": one(_known(c(o, "visual_place")) & F.array_contains(c(e, "visual_places"), c(o, "visual_place")), "visual_place"),
        "kind": one(_known(c(o, "kind")) & F.array_contains(c(e, "kinds"), c(o, "kind")), "kind"),
        "activity": one(_known(a) & _known(b) & (F.contains(a, b) | F.contains(b, a)), "activity"),
        "objects": one(F.arrays_overlap(c(o, "objects"), c(e, "objects")), "objects"),
        "people": one(F.arrays_overlap(c(o, "people"), c(e, "people")), "people"),
        "similarity": alike,
    }
    parts["visual"] = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (alike - 0.70) / 0.30)), F.lit(0.0))
    parts["bonus"] = F.when((parts["time"] >= 0.9) & (parts["location"] >= 0.9), 1.0).otherwise(0.0)
    # Other words alone don't part an event; other words, another kind and an unlike picture do, if nothing bridges them.
    conflict = _known(a) & _known(b) & (a != b) & _known(c(o, "kind")) & (F.size(c(e, "kinds")) > 0) & ~F.array_contains(c(e, "kinds"), c(o, "kind"))
    parts["split"] = F.coalesce(conflict & (alike < 0.45) & (parts["objects"] == 0) & (parts["people"] == 0), F.lit(False))
    return parts


def candidate_total(parts: dict[str, Column]) -> Column:
    total = reduce(lambda acc, name: acc + parts[name] * WEIGHTS[name], WEIGHTS, F.lit(0.0))
    return F.when(parts["split"], 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def candidates(observations: DataFrame, events: DataFrame) -> DataFrame:
    """obs_id, event_id, start_ts and score of all pairs of a scope within six hours: an equi-join on scope and time slot."""
    pairs = within(observations.select("scope_id", "obs_id", "ts"), events.select("scope_id", F.col("event_id"), "start_ts"), ["scope_id"], "ts", "start_ts", WINDOW_S).select("obs_id", "event_id")
    wide = pairs.join(observations.alias("o"), "obs_id").join(events.alias("e"), "event_id")
    return wide.select("obs_id", "event_id", F.col("e.start_ts").alias("start_ts"), candidate_total(candidate_parts("o", "e")).alias("score"))


def best_candidates(scored: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    """Of each observation the candidate of the highest score, of the minimum at least; ties go to the earlier event, then its id."""
    best = F.min(F.struct((-F.round("score", 9)).alias("s"), "start_ts", "event_id")).alias("b")
    return scored.filter(F.round("score", 9) >= minimum).groupBy("obs_id").agg(best).select("obs_id", F.col("b.event_id").alias("event_id"), (-F.col("b.s")).alias("score"))


# --- online assignment -----------------------------------------------------------------------------------------------


@dataclass
class OpenEvent:
    """An event that later observations may join: the union of its observations."""

    event_id: str
    start: float
    activity: str
    held: dict[str, set] = field(default_factory=lambda: {k: set() for k in ("location", "visual_place", "kind", "objects", "people")})
    spots: list[tuple[float, float]] = field(default_factory=list)
    vectors: list[np.ndarray] = field(default_factory=list)

    def take(self, o: dict) -> None:
        for k in ("location", "visual_place", "kind"):
            if o.get(k):
                self.held[k].add(o[k])
        for k in ("objects", "people"):
            self.held[k] |= o.get(k) or set()
        if o.get("gps"):
            self.spots.append(o["gps"])
        if o.get("vector") is not None:
            self.vectors.append(o["vector"])


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    x, y, u, v = map(radians, (*a, *b))
    return 2 * EARTH_KM * asin(sqrt(min(1.0, sin((u - x) / 2) ** 2 + cos(x) * cos(u) * sin((v - y) / 2) ** 2)))


def _likeness(o: dict, e: OpenEvent) -> float | None:
    x = o.get("vector")
    own = [v for v in e.vectors if len(v) == len(x)] if x is not None else []
    return max((float(v @ x / n) if (n := np.linalg.norm(v) * np.linalg.norm(x)) else 0.0 for v in own), default=None)


def score_of(o: dict, e: OpenEvent) -> float:
    """The same score as candidate_total, of one observation (a dict, seconds as t) and one open event."""
    got = {"time": max(0.0, 1 - abs(o["t"] - e.start) / 60 / REACH_MINUTES) if o.get("t") is not None else UNKNOWN_TIME}
    if o.get("gps"):
        got["location"] = max((max(0.0, 1 - _km(o["gps"], s) / REACH_KM) for s in e.spots), default=0.0)
    else:
        got["location"] = float(bool(o.get("location")) and o["location"] in e.held["location"])
    for k in ("visual_place", "kind"):
        got[k] = MATCH[k] * (bool(o.get(k)) and o[k] in e.held[k])
    a, b = (o.get("activity") or "").lower(), (e.activity or "").lower()
    got["activity"] = MATCH["activity"] * bool(a and b and (a in b or b in a))
    for k in ("objects", "people"):
        got[k] = MATCH[k] * bool((o.get(k) or set()) & e.held[k])
    alike = _likeness(o, e)
    got["visual"] = min(1.0, max(0.0, (alike - 0.70) / 0.30)) if alike is not None else 0.0
    got["bonus"] = float(got["time"] >= 0.9 and got["location"] >= 0.9)
    conflict = a and b and a != b and o.get("kind") and e.held["kind"] and o["kind"] not in e.held["kind"]
    if conflict and alike is not None and alike < 0.45 and not got["objects"] and not got["people"]:
        return 0.0
    return min(1.0, sum(WEIGHTS[k] * got[k] for k in WEIGHTS))


def assign(observations: Iterator[dict], minimum: float = MINIMUM, opened: list[OpenEvent] | None = None, keep_seconds: float = WINDOW_S) -> Iterator[tuple[object, str, float]]:
    """(obs_id, event_id, score) of one scope's observations, in order of arrival.

    Candidates began within six hours of the observation, before or after. `opened` is the state, which is changed in place:
    events that began more than keep_seconds before the newest observation leave it.
    """
    opened = [] if opened is None else opened
    newest = max((e.start for e in opened), default=float("-inf"))
    for o in observations:
        newest = max(newest, o["t"])
        opened[:] = [e for e in opened if newest - e.start <= keep_seconds]
        near = (e for e in opened if abs(o["t"] - e.start) <= WINDOW_S)
        best = min(((-round(score_of(o, e), 9), e.start, e.event_id, e) for e in near), key=lambda x: x[:3], default=None)
        if best and -best[0] >= minimum:
            score, event = -best[0], best[3]
        else:
            score, event = 0.0, OpenEvent(f"event_{o['obs_id']}", o["t"], o.get("activity") or "")
            opened.append(event)
        event.take(o)
        yield o["obs_id"], event.event_id, score


def as_dicts(rows: pd.DataFrame) -> Iterator[dict]:
    for r in rows.to_dict("records"):
        gps, vector = r.get("gps"), r.get("vector")
        arrays = {k: set(r[k]) if r.get(k) is not None else set() for k in ("objects", "people")}
        yield r | arrays | {"gps": (gps["lat"], gps["lon"]) if isinstance(gps, dict) else None, "vector": np.asarray(vector, float) if vector is not None and not np.isscalar(vector) else None}


def assigned(observations: DataFrame) -> DataFrame:
    """scope_id, obs_id, event_id and score. A scope's observations stream by in order of (time, id), batch by batch."""
    columns = ["scope_id", "obs_id", "t", "location", "visual_place", "kind", "activity", "objects", "people", "gps", "vector"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, feed, out = None, None, []

        def follow(queue: list[dict]) -> Iterator[tuple]:
            def endless() -> Iterator[dict]:
                while True:
                    yield queue.pop()

            return assign(endless())

        queue: list[dict] = []
        for rows in batches:
            for o in as_dicts(rows):
                if feed is None or o["scope_id"] != scope:
                    scope, queue = o["scope_id"], []
                    feed = follow(queue)
                queue.append(o)
                out.append((scope, *next(feed)))
            yield pd.DataFrame(out, columns=["scope_id", "obs_id", "event_id", "score"])
            out = []

    kind = lambda c: observations.schema[c].dataType.simpleString()
    rows = observations.withColumn("t", micros("ts") / 1e6).filter("t IS NOT NULL").select(*columns)
    ordered = rows.repartition("scope_id").sortWithinPartitions("scope_id", "t", "obs_id")
    return ordered.mapInPandas(run, f"scope_id {kind('scope_id')}, obs_id {kind('obs_id')}, event_id string, score double")


# --- consolidation ---------------------------------------------------------------------------------------------------

#: Events can merge only if two of their observations are so near in time (a time score of 0.70).
MERGE_GAP_S = 108 * 60


def pair_score(minutes: Column, metres: Column, visual: Column, semantic: Column, faces: Column) -> tuple[Column, Column]:
    """Total and merge rule of two events, from the least distances and greatest likenesses of their observations."""
    time = F.coalesce(decay(minutes, 360.0), F.lit(0.0))
    location = F.coalesce(decay(metres, 1000.0), F.lit(0.0))
    seen = F.coalesce(visual, F.lit(0.0))
    bridged = (semantic > 0) | faces
    merge = (time >= 0.70) & ((location >= 0.65) & ((seen >= 0.55) | bridged) | (seen >= 0.80) & bridged | (location >= 0.85) & (semantic > 0))
    # The weights of the total.
    return 0.35 * time + 0.25 * location + 0.25 * seen + 0.10 * semantic + F.when(faces, 0.05).otherwise(0.0), merge


@dataclass
class _Merged:
    """An event under consolidation: its observations' times, places, unit vectors by length, words and people, in pieces."""

    place: int  # in the order of events, by which equal totals are told apart
    n: int
    start: float
    pieces: list[tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]]
    words: frozenset
    people: frozenset

    @classmethod
    def of(cls, place: int, rows: list[dict]) -> _Merged:
        t = np.sort(np.array([r["t"] for r in rows], float))
        gps = np.radians(np.array([r["gps"] for r in rows if r["gps"]], float).reshape(-1, 2))
        by_length: dict[int, list] = {}
        for r in rows:
            if r["vector"] is not None and (n := np.linalg.norm(r["vector"])):
                by_length.setdefault(len(r["vector"]), []).append(np.asarray(r["vector"]) / n)
        words = frozenset(w for r in rows for w in (r["activity"], r["kind"], *r["objects"]) if w)
        return cls(place, len(rows), float(t[0]), [(t, gps, {k: np.array(v) for k, v in by_length.items()})], words, frozenset().union(*(r["people"] for r in rows)))

    def whole(self) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """All pieces as one; put together only when a further event has to be compared."""
        if len(self.pieces) > 1:
            t, gps, x = zip(*self.pieces)
            lengths = set().union(*x)
            self.pieces = [(np.sort(np.concatenate(t)), np.concatenate(gps), {n: np.concatenate([v[n] for v in x if n in v]) for n in lengths})]
        return self.pieces[0]

    def take(self, other: _Merged) -> None:
        self.n, self.start, self.pieces = self.n + other.n, min(self.start, other.start), self.pieces + other.pieces
        self.words, self.people = self.words | other.words, self.people | other.people


@lru_cache(maxsize=1 << 16)
def _semantic(a: frozenset, b: frozenset) -> float:
    if a & b:
        return 1.0
    return 0.7 if any(len(p) >= 2 and len(q) >= 2 and (p in q or q in p) for p in a for q in b) else 0.0


#: Products of observations that are formed at once.
_CUT = 1 << 20


def merge_parts(a: _Merged, b: _Merged) -> tuple[float, float, float, float, bool]:
    """Nearness in time and place, likeness of vectors and words, and shared people of two events: the best of any two observations.

    All five are maxima over pairs of observations, so those of a merged event are the maxima of its parts' own.
    """
    (t, gps, x), (u, hps, y) = a.whole(), b.whole()
    if len(t) > len(u):
        t, u = u, t
    at = np.searchsorted(u, t)
    gap = min(np.abs(u[np.minimum(at, len(u) - 1)] - t).min(), np.abs(u[np.maximum(at - 1, 0)] - t).min())
    place = seen = 0.0
    if len(gps) and len(hps):
        for i in range(0, len(gps), max(1, _CUT // len(hps))):
            some = gps[i : i + max(1, _CUT // len(hps)), None]
            d = some - hps
            h = np.sin(d[..., 0] / 2) ** 2 + np.cos(some[..., 0]) * np.cos(hps[:, 0]) * np.sin(d[..., 1] / 2) ** 2
            place = max(place, float(1 - 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h.min(), 0, 1)))))
    for n in x.keys() & y.keys():
        step = max(1, _CUT // len(y[n]))
        seen = max([seen] + [float((x[n][i : i + step] @ y[n].T).max()) for i in range(0, len(x[n]), step)])
    return max(0.0, 1 - gap / 60 / 360), place, seen, _semantic(a.words, b.words), bool(a.people & b.people)


def merge_total(time: float, location: float, seen: float, semantic: float, faces: bool) -> float | None:
    """pair_score of two events at hand, rounded; None if they must not merge."""
    bridged = semantic > 0 or faces
    merge = time >= 0.70 and (location >= 0.65 and (seen >= 0.55 or bridged) or seen >= 0.80 and bridged or location >= 0.85 and semantic > 0)
    return round(0.35 * time + 0.25 * location + 0.25 * seen + 0.10 * semantic + 0.05 * faces, 9) if merge else None


def consolidation(events: dict[object, list[dict]]) -> dict:
    """Which event each one ends in: the best pair that may merge first, scored anew after every merge.

    The event of more observations (then the later start) takes in the other. Only pairs that are near in time are kept, and
    those that may merge are in a heap; what a merge has changed is pushed again, and outdated pairs are passed over when they
    come up. So the work grows with the near pairs, not with all pairs.
    """
    names = sorted(events)
    live = {i: _Merged.of(i, events[k]) for i, k in enumerate(names)}
    near: list[dict[int, tuple]] = [{} for _ in names]
    heap: list[tuple] = []

    def keep(a: int, b: int, parts: tuple) -> None:
        near[a][b] = near[b][a] = parts
        total = merge_total(*parts)
        if total is not None:
            heappush(heap, (-total, min(a, b), max(a, b), id(parts), parts))

    # Pairs with observations within the gap: over all of them in order of time, those that are still open.
    open_: deque[tuple[float, int]] = deque()
    for t, b in sorted((t, i) for i, e in live.items() for t in e.pieces[0][0].tolist()):
        while open_ and t - open_[0][0] > MERGE_GAP_S:
            open_.popleft()
        for a in {a for _, a in open_} - near[b].keys() - {b}:
            keep(a, b, merge_parts(live[a], live[b]))
        open_.append((t, b))
    into = list(range(len(names)))
    while heap:
        _, a, b, _, parts = heappop(heap)
        if a not in live or b not in live or near[a].get(b) is not parts:
            continue
        x, y = live[a], live[b]
        target, source = (a, b) if (x.n, x.start) >= (y.n, y.start) else (b, a)
        del near[target][source], near[source][target]
        for other in near[target].keys() | near[source].keys():
            both = [near[k].get(other) or merge_parts(live[k], live[other]) for k in (target, source)]
            near[other].pop(source, None)
            keep(target, other, tuple(map(max, *both)))
        near[source] = {}
        live[target].take(live.pop(source))
        into[source] = target

    def end(i: int) -> int:
        while into[i] != i:
            into[i] = into[into[i]]
            i = into[i]
        return i

    return {k: names[end(i)] for i, k in enumerate(names)}


def consolidated(observations: DataFrame, event: str = "event_id") -> DataFrame:
    """scope_id, event_id and into: which event each one ends in.

    Two events can only merge if observations of theirs are within MERGE_GAP_S, so a scope's events are first parted where
    no event reaches over such a gap; each part is one fold. An event alone in its part stays as it is and takes no part in
    the folds; the other parts stream by in order, many of them in a batch.
    """
    rows = observations.withColumn("t", micros("ts") / 1e6).filter("t IS NOT NULL")
    spans = rows.groupBy("scope_id", event).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    w = W.partitionBy("scope_id").orderBy("a", event)
    reach = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    parted = spans.withColumn("new", F.coalesce((F.col("a") - reach > MERGE_GAP_S).cast("int"), F.lit(0)))
    parts = parted.withColumn("part", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("events", F.count(F.lit(1)).over(W.partitionBy("scope_id", "part")))
    parts = parts.select("scope_id", event, "part", "events").filter(F.col("scope_id").isNotNull() & F.col(event).isNotNull())
    alone = parts.filter("events = 1").select("scope_id", event, F.col(event).alias("into"))
    columns = ["t", "kind", "activity", "objects", "people", "gps", "vector"]

    def folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, out = None, {}, []
        for b in batches:
            for key, o in zip(zip(b["scope_id"], b["part"]), as_dicts(b)):
                if key != at:
                    out += [(at[0], *x) for x in consolidation(held).items()] if held else []
                    at, held = key, {}
                held.setdefault(o[event], []).append(o)
            if out:
                yield pd.DataFrame(out, columns=["scope_id", event, "into"])
                out = []
        if held:
            yield pd.DataFrame([(at[0], *x) for x in consolidation(held).items()], columns=["scope_id", event, "into"])

    kind = lambda c: observations.schema[c].dataType.simpleString()
    joined = rows.join(parts.filter("events > 1"), ["scope_id", event]).select("scope_id", event, "part", *columns)
    ordered = joined.repartition("scope_id", "part").sortWithinPartitions("scope_id", "part")
    folded = ordered.mapInPandas(folds, f"scope_id {kind('scope_id')}, {event} {kind(event)}, into {kind(event)}")
    return alone.unionByName(folded)


def resegmented(observations: DataFrame, person: str, event: str = "event_id") -> DataFrame:
    """event_id and other: of each event of a newly confirmed person the first other one that should join it.

    An other event joins if the first of its observations that shows the person scores as a candidate; both start within
    six hours. observations: with event_id.
    """
    seen = observations.filter(F.array_contains("people", person))
    first = seen.groupBy("scope_id", event).agg(F.min("obs_id").alias("obs_id"))
    bridging = seen.join(first.select("obs_id"), "obs_id", "left_semi").withColumnRenamed(event, "other")
    profiles = event_profiles(observations, event)
    theirs = profiles.join(first.select(event), event, "left_semi")
    starts = profiles.select(F.col(event).alias("other"), F.col("start_ts").alias("other_ts"))
    pairs = within(starts.join(first.select("scope_id", F.col(event).alias("other")), "other"), theirs.select("scope_id", event, "start_ts"), ["scope_id"], "other_ts", "start_ts", WINDOW_S)
    pairs = pairs.filter(F.col(event) != F.col("other")).select(event, "other")
    wide = pairs.join(bridging.alias("o"), "other").join(theirs.alias("e"), event)
    scored = wide.select(event, "other", candidate_total(candidate_parts("o", "e")).alias("score")).filter(F.round("score", 9) >= MINIMUM)
    return scored.groupBy(event).agg(F.min("other").alias("other"))


def semantic_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(set_overlap(a, b), F.lit(0.0))


# --- summaries -------------------------------------------------------------------------------------------------------

# Place names that say nothing.
WEAK_PLACES = ("", "OTHER", "某处", "地点未知", "未标注", "未标注地点", "待判断")
OTHER = "OTHER"
_COORDINATES = r"^\s*-?\d+(\.\d+)?\s*,\s*-?\d+(\.\d+)?\s*$"


def event_summaries(events: DataFrame, observations: DataFrame, names: DataFrame, event: str = "event_id") -> DataFrame:
    """event_id, place and summary. events: event_id, place, activity, prefix. names: event_id, seq, name.

    A place that says something stays; else the first observation's that does (by time, then id); else what there is. The
    summary says who took part where in what, after the prefix of the place's wider area if that isn't in it yet.
    """
    weak = lambda c: c.isNull() | F.trim(c).isin(*WEAK_PLACES) | F.trim(c).rlike(_COORDINATES)
    shown = observations.filter(~weak(F.col("place"))).groupBy(event).agg(F.min_by("place", F.struct("ts", "obs_id")).alias("__shown"))
    who = names.filter("name <> ''").groupBy(event, "name").agg(F.min("seq").alias("seq")).groupBy(event).agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("n"))
    who = who.select(event, F.array_join(F.transform("n", lambda x: x["name"]), "、").alias("__who"))
    rows = events.join(shown, event, "left").join(who, event, "left")
    own = F.trim(F.coalesce("place", F.lit("")))
    place = F.when(~weak(F.col("place")), own).otherwise(F.coalesce("__shown", F.when(own != "", own), F.lit(OTHER)))
    rows = rows.withColumn("__place", place)
    body = F.when(F.col("__who").isNotNull(), F.concat("__who", F.lit("在"), "__place", F.lit("参与"), "activity")).otherwise(F.concat(F.lit("在"), "__place", F.lit("发生的"), "activity"))
    area = F.concat(F.lit("在"), F.col("prefix"))
    summary = F.when(F.coalesce(F.col("prefix") != "", F.lit(False)) & ~F.contains(body, area), F.concat(area, F.lit("，"), body)).otherwise(body)
    return rows.select(event, F.col("__place").alias("place"), summary.alias("summary"))


def trips(events: DataFrame, scope: str, key: str, ts: str, place: str, lat: str, lon: str, gap_days: float = 3, km: float = 50, most_days: int = 10) -> DataFrame:
    """Trips: sessions by gap with two events or more, over more than one day, at most most_days, two places, far apart.

    The farthest pair is found among the distinct positions of sessions that meet all other limits.
    """
    found = sessions(events, [scope], ts, key, gap_days * 86400)
    keys = [scope, "session_no"]
    spans = found.groupBy(*keys).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("events"), F.countDistinct(place).alias("places"))
    spans = spans.filter((F.col("events") >= 2) & F.datediff("end_ts", "start_ts").between(1, most_days) & (F.col("places") >= 2))
    spots = found.join(spans.select(*keys), keys, "left_semi").filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*keys, lat, lon).distinct()
    other = spots.select(*keys, F.col(lat).alias("__lat"), F.col(lon).alias("__lon"))
    far = spots.join(other, keys).groupBy(*keys).agg(F.max(haversine(F.col(lat), F.col(lon), F.col("__lat"), F.col("__lon"))).alias("km"))
    kept = spans.join(far, keys).filter(F.col("km") >= km)
    return kept.withColumn("confidence", F.least(F.lit(0.9), 0.45 + 0.08 * F.col("events") + 0.04 * F.col("places")))
