"""Queries that SQL can't express, held against plain models on the same rows."""

import math
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog, registry
from tessera.operators import clusters, events
from tessera.plans import queries_events, queries_video

SF = "/root/testdata/sf0.001"
registry.load()


def seconds(ts):
    return ts.replace(tzinfo=UTC).timestamp()


@pytest.fixture(scope="module")
def seen(spark):
    rows = queries_events.observations(spark, SF).collect()
    return [{"obs_id": r.obs_id, "scope": r.scope_id, "t": seconds(r.ts), "location": r.location, "visual_place": r.visual_place, "kind": r.kind, "activity": r.activity, "objects": set(r.objects), "people": set(r.people), "gps": (r.gps.lat, r.gps.lon) if r.gps else None, "x": np.array(r.vector) if r.vector else None, "event": r.event_id} for r in rows]


def km(a, b):
    p, q, r, s = (math.radians(v) for v in (*a, *b))
    return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2))


def cos(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def plain_score(o, start, activity, members):
    """The score of an observation for an event, part by part, from the event's member observations."""
    t = max(0, 1 - abs(o["t"] - start) / 21600)
    if o["gps"]:
        loc = max([max(0, 1 - km(o["gps"], m["gps"]) / 2) for m in members if m["gps"]], default=0)
    else:
        loc = 1 if o["location"] and o["location"] in [m["location"] for m in members] else 0
    place = 1 if o["visual_place"] in [m["visual_place"] for m in members] else 0
    kind = o["kind"] in [m["kind"] for m in members]
    a, b = o["activity"].lower(), activity.lower()
    act = a in b or b in a
    obj, ppl = any(o["objects"] & m["objects"] for m in members), any(o["people"] & m["people"] for m in members)
    sims = [cos(o["x"], m["x"]) for m in members if m["x"] is not None and o["x"] is not None]
    if a != b and not kind and sims and max(sims) < 0.45 and not obj and not ppl:
        return 0.0
    boost = min(1, max(0, (max(sims) - 0.7) / 0.3)) if sims else 0
    return min(1, 0.25 * t + 0.25 * loc + 0.15 * place + 0.04 * kind + 0.18 * act + 0.04 * obj + 0.16 * ppl + 0.05 * boost + (0.2 if t >= 0.9 and loc >= 0.9 else 0))


def test_event_assignment(spark, seen):
    want = {}
    for scope in {o["scope"] for o in seen}:
        made = []  # (id, start, activity, members)
        for o in sorted((o for o in seen if o["scope"] == scope), key=lambda o: (o["t"], o["obs_id"])):
            fits = [(-round(plain_score(o, s, a, m), 9), s, i, m) for i, s, a, m in made if o["t"] - s <= 21600]
            fits = sorted((f for f in fits if -f[0] >= 0.5), key=lambda f: f[:3])
            if fits:
                want[o["obs_id"]] = fits[0][2]
                fits[0][3].append(o)
            else:
                want[o["obs_id"]] = f"event_{o['obs_id']}"
                made.append((f"event_{o['obs_id']}", o["t"], o["activity"], [o]))
    rows = registry.QUERIES["event_assignment"](spark, SF).collect()
    assert {r.obs_id: r.event_id for r in rows} == want and len(set(want.values())) < len(want)


def test_streamed_assignment_is_the_same(spark):
    batch = {(r.obs_id, r.event_id) for r in registry.QUERIES["event_assignment"](spark, SF).collect()}
    assert {(r.obs_id, r.event_id) for r in registry.QUERIES["stream_assignment"](spark, SF).collect()} == batch


def test_late_observations_are_held_against_older_events():
    o = lambda i, t: {"obs_id": i, "t": t, "location": "p", "visual_place": "v", "kind": "k", "activity": "walk", "objects": {"o"}, "people": {"u"}, "gps": None, "vector": None}
    state = []
    found = [e for _, e, _ in events.assign(iter([o(1, 0.0), o(2, 30_000.0)]), opened=state, keep_seconds=40_000)]
    found += [e for _, e, _ in events.assign(iter([o(3, 60.0), o(4, 90_000.0), o(5, 61.0)]), opened=state, keep_seconds=40_000)]
    assert found == ["event_1", "event_2", "event_1", "event_4", "event_5"]  # the first event left the state with the fourth


def test_event_consolidation(spark, seen):
    def score(a, b):
        t = max(max(0, 1 - abs(x["t"] - y["t"]) / 21600) for x in a for y in b)
        loc = max([max(0, 1 - km(x["gps"], y["gps"])) for x in a for y in b if x["gps"] and y["gps"]], default=0)
        sim = max([cos(x["x"], y["x"]) for x in a for y in b if x["x"] is not None and y["x"] is not None], default=0)
        words = lambda es: {w for e in es for w in (e["activity"], e["kind"], *e["objects"])}
        p, q = words(a), words(b)
        sem = 1 if p & q else 0.7 if any(len(x) >= 2 and len(y) >= 2 and (x in y or y in x) for x in p for y in q) else 0
        face = any(x["people"] & y["people"] for x in a for y in b)
        merge = t >= 0.7 and (loc >= 0.65 and (sim >= 0.55 or sem > 0 or face) or sim >= 0.8 and (sem > 0 or face) or loc >= 0.85 and sem > 0)
        return round(0.35 * t + 0.25 * loc + 0.25 * sim + 0.1 * sem + 0.05 * face, 9), merge

    want = {}
    for scope in {o["scope"] for o in seen}:
        live = {}
        for o in seen:
            if o["scope"] == scope:
                live.setdefault(o["event"], []).append(o)
        into = {k: k for k in live}
        while True:
            best = None
            for i, a in enumerate(sorted(live)):
                for b in sorted(live)[i + 1 :]:
                    s, merge = score(live[a], live[b])
                    if merge and (best is None or s > best[0]):
                        best = (s, a, b)
            if best is None:
                break
            _, a, b = best
            rank = lambda k: (len(live[k]), min(o["t"] for o in live[k]))
            target, source = (a, b) if rank(a) >= rank(b) else (b, a)
            live[target] += live.pop(source)
            into = {k: target if v == source else v for k, v in into.items()}
        want |= into
    found = {r.event_id: r.into for r in registry.QUERIES["event_consolidation"](spark, SF).collect()}
    assert found == want and any(k != v for k, v in want.items())


@pytest.mark.parametrize("strategy", ["all", "mean", "topk", "p10"])
def test_quality_clusters(spark, strategy):
    rows = catalog.load(spark, SF, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 4).alias("scope"), ((F.col("vec_id") * 37 % 101) / 100).alias("q"), F.element_at(F.array(F.lit("frontal"), F.lit("left"), F.lit("unknown")), (F.col("vec_id") % 3 + 1).cast("int")).alias("pose"), F.concat(F.lit("m"), (F.col("vec_id") % 8).cast("string")).alias("model"), F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("n"), (F.col("vec_id") % 2).cast("string"))).alias("kept"))
    x = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in rows.collect()}
    info = {r.vec_id: r for r in rows.collect()}
    want = {}
    for scope, model in {(r.scope, r.model) for r in info.values()}:
        made = []
        for i in sorted((i for i, r in info.items() if (r.scope, r.model) == (scope, model)), key=lambda i: (-info[i].q, i)):
            options = []
            for n, c in enumerate(made):
                views = {}
                for j in c:
                    views.setdefault(info[j].pose, j)  # the first, so best, of each view
                if info[c[0]].q >= 0.3:
                    options.append((-max(float(x[j] @ x[i]) for j in list(views.values())[:6]), n))
            joined = False
            for s, n in sorted(options) if info[i].q >= 0.3 else []:
                own = sorted(float(x[j] @ x[i]) for j in made[n] if info[i].pose == "unknown" or info[j].pose == info[i].pose)
                value = {"all": own[0], "mean": sum(own) / len(own), "topk": sum(own[-3:]) / len(own[-3:]), "p10": own[int(len(own) * 0.1)]}[strategy] if own else 1
                names = {info[j].kept for j in made[n] if info[j].kept}
                if -s >= 0.05 and value >= 0.05 and not (info[i].kept and names and info[i].kept not in names):
                    made[n].append(i)
                    joined = True
                    break
            if not joined:
                made.append([i])
        want |= {i: c[0] for c in made for i in c}
    found = clusters.cluster_by_quality(rows, "scope", "vec_id", "embedding", "q", "pose", "model", "kept", threshold=0.05, strategy=strategy)
    assert {r.vec_id: r.cluster for r in found.collect()} == want and len(set(want.values())) < len(want)


def test_boundary_peaks_spaced(spark):
    by = {}
    log = {r.event_id: r.ts for r in catalog.load(spark, SF, "events").collect()}
    user = {r.event_id: r.user_id for r in catalog.load(spark, SF, "events").collect()}
    for r in registry.QUERIES["boundary_peaks"](spark, SF).collect():
        by.setdefault(user[r.event_id], []).append(r)
    kept = {(r.user_id, r.event_id) for r in registry.QUERIES["boundary_peaks_spaced"](spark, SF).collect()}
    want = set()
    for who, rows in by.items():
        last = -math.inf
        for r in sorted(rows, key=lambda r: (log[r.event_id], r.event_id)):
            t = seconds(log[r.event_id])
            if t - last >= GAP:
                want.add((who, r.event_id))
                last = t
    assert kept == want and kept


GAP = 86400.0


def by_video(spark):
    out = {}
    for r in queries_video.frames(spark, SF).collect():
        out.setdefault(r.video, []).append(r)
    return {v: sorted(rows, key=lambda r: r.t) for v, rows in out.items()}


def test_greedy_boundaries(spark):
    want = set()
    for v, rows in by_video(spark).items():
        s = np.array([r.score for r in rows])
        limit = max(0.24, float(np.median(s) + 2.4 * np.median(np.abs(s - np.median(s)))))
        chosen = [0]
        for i in sorted(range(1, len(rows)), key=lambda i: (-s[i], i)):
            if s[i] >= limit and all(abs(rows[i].t - rows[j].t) >= 2.5 and abs(i - j) >= 3 for j in chosen):
                chosen.append(i)
        want |= {(v, rows[i].frame) for i in chosen}
    assert {(r.video, r.frame) for r in registry.QUERIES["greedy_boundaries"](spark, SF).collect()} == want


def test_summary_frames(spark):
    want = set()
    for v, rows in by_video(spark).items():
        budget = min(len(rows), math.ceil(24.0 * 30 * 0.15 / 0.5))
        chosen = []
        for r in sorted(rows, key=lambda r: (-r.score, -r.gain, r.t)):
            if len(chosen) < budget and all(abs(r.t - c.t) >= 4.0 for c in chosen):
                chosen.append(r)
        for r in rows:
            if len(chosen) < budget and r not in chosen:
                chosen.append(r)
        want |= {(v, r.frame) for r in chosen}
    assert {(r.video, r.frame) for r in registry.QUERIES["summary_frames"](spark, SF).collect()} == want


def test_gated_keyframes(spark):
    want = {}
    for rows in by_video(spark).values():
        last, sharp = None, []
        for r in rows:
            reference = float(np.percentile(sharp[-120:], 70)) if sharp else r.score * 100
            sharp.append(r.score * 100)
            gain = 0.72 * r.gain + 0.28 * min(1, (r.frame % 20) / 15)
            if r.score * 100 < reference * 0.8 - 1e-9:
                want[r.frame] = "blurred"
            elif last is None:
                want[r.frame] = "first"
            elif r.t - last >= 24.0:
                want[r.frame] = "maximum_gap"
            elif r.t - last >= 2.0 and gain >= 0.5:
                want[r.frame] = "information_gain"
            else:
                want[r.frame] = "redundant"
            if want[r.frame] not in ("blurred", "redundant"):
                last = r.t
    assert {r.frame: r.gate for r in registry.QUERIES["gated_keyframes"](spark, SF).collect()} == want


def test_greedy_tracks(spark):
    kinds = {r.event_id: r.event_type for r in catalog.load(spark, SF, "events").collect()}
    want = set()
    for rows in by_video(spark).values():
        days = {}
        for r in rows:
            days.setdefault(math.floor(r.t / 24), []).append(r)
        for day in days.values():
            a, b = [r for r in day if kinds[r.frame] == "view"], [r for r in day if kinds[r.frame] == "click"]
            used = set()
            for c, i, j in sorted((round(abs(p.x - q.x) + abs(p.y - q.y), 9), p.frame, q.frame) for p in a for q in b):
                if c <= 0.5 and not {("d", i), ("t", j)} & used:
                    used |= {("d", i), ("t", j)}
                    want.add((i, j))
    assert {(r.detection, r.track) for r in registry.QUERIES["greedy_tracks"](spark, SF).collect()} == want


def test_held_out_split(spark):
    rows = registry.QUERIES["held_out_split"](spark, SF).collect()
    hidden = [r for r in rows if r.hidden]
    assert len(hidden) == min(50, len(rows)) and {r.p_type for r in hidden} == {r.p_type for r in rows}
    again = registry.QUERIES["held_out_split"](spark, SF)
    assert {r.p_partkey for r in again.collect() if r.hidden} == {r.p_partkey for r in hidden}


def test_dmd_and_camera_shift(spark):
    from tessera.operators import timeline

    rng = np.random.default_rng(1)
    picture = rng.random((16, 12))
    moved = np.roll(picture, (3, -2), axis=(0, 1))
    assert timeline.camera_shift(picture, moved) == (3, -2)
    rows = spark.createDataFrame([(1, i, np.roll(picture, (i, 0), axis=(0, 1)).ravel().tolist()) for i in range(3)], "video int, n int, p array<double>")
    assert [(r.shift_rows, r.shift_columns) for r in timeline.camera_shifts(rows, "video", "n", "p", 12).orderBy("n").collect()] == [(0, 0), (1, 0), (1, 0)]
    turn = lambda a: [math.cos(a), math.sin(a), 1.0]
    rows = spark.createDataFrame([(1, i, turn(0.3 * i)) for i in range(9)] + [(1, 9, [5.0, -3.0, 2.0])], "video int, n int, v array<double>")
    found = {r.n: r.dmd_residual for r in timeline.dmd_residuals(rows, "video", "n", "v").collect()}
    assert found[0] == found[1] == 0 and all(found[i] < 1e-6 for i in range(5, 9)) and found[9] > 0.3


def test_surprises_and_shifts_of_vectors(spark):
    by_label = {}
    for r in catalog.load(spark, SF, "embeddings").orderBy("vec_id").collect():
        by_label.setdefault(r.label, []).append((r.vec_id, np.array(r.embedding, float)))
    surprise, shift = {}, {}
    turns = np.exp(-2j * np.pi * np.outer(np.arange(8), np.arange(8)) / 8)
    for rows in by_label.values():
        for n, (i, v) in enumerate(rows):
            past = np.stack([x for _, x in rows[max(0, n - 10) : n + 1]], axis=1)
            surprise[i], shift[i] = 0.0, (0, 0)
            if past.shape[1] >= 3:
                u, s, vt = np.linalg.svd(past[:, :-1], full_matrices=False)
                r = min(4, int((s > 1e-10).sum()))
                inverse = vt[:r].T @ np.diag(1 / s[:r]) @ u[:, :r].T
                guess = u[:, :r] @ u[:, :r].T @ past[:, 1:] @ inverse @ u[:, :r] @ u[:, :r].T @ past[:, -2]
                surprise[i] = np.linalg.norm(v - guess) / (np.linalg.norm(v) + 1e-9)
            if n:
                a, b = (turns @ x.reshape(8, 8) @ turns for x in (v, rows[n - 1][1]))
                phase = a * b.conj() / np.maximum(np.abs(a * b.conj()), 1e-12)
                back = np.abs(turns.conj() @ phase @ turns.conj())
                shift[i] = tuple(p - 8 if p > 4 else p for p in divmod(int(back.argmax()), 8))
    found = {r.vec_id: r.surprise for r in registry.QUERIES["frame_surprises"](spark, SF).collect()}
    assert found.keys() == surprise.keys() and max(abs(found[i] - surprise[i]) for i in found) < 2e-6
    assert {r.vec_id: (r.shift_rows, r.shift_columns) for r in registry.QUERIES["camera_shifts"](spark, SF).collect()} == shift


def test_boxes_are_suppressed(spark):
    rows = spark.createDataFrame([(1, "x", 0.9, 0.0, 0.0, 2.0, 2.0), (1, "x", 0.8, 0.0, 0.0, 2.0, 2.1), (1, "y", 0.7, 0.0, 0.0, 2.0, 2.0), (1, "x", 0.6, 5.0, 5.0, 6.0, 6.0), (2, "x", 0.1, 0.0, 0.0, 2.0, 2.0)], "f int, label string, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.f, r.score) for r in clusters.suppress(rows, ["f"], "label", "score").collect()) == [(1, 0.6), (1, 0.7), (1, 0.9), (2, 0.1)]
    assert datetime(2024, 1, 1).year == 2024


def test_long_intervals_overlap_once(spark):
    from tessera.operators import joins

    rng = np.random.default_rng(3)
    spans = lambda n, k: [(1, i, float(a), float(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 10**7, n), 10.0 ** rng.integers(0, k, n)))]
    a, b = spans(60, 8), spans(60, 5)
    df = lambda rows, c: spark.createDataFrame(rows, f"k int, {c} int, s double, e double").select("k", c, F.timestamp_seconds("s").alias(f"{c}s"), F.timestamp_seconds("e").alias(f"{c}e"))
    found = joins.overlaps(df(a, "a"), df(b, "b"), ["k"], "as", "ae", "bs", "be", 60.0).select("a", "b").collect()
    assert sorted((r.a, r.b) for r in found) == sorted((i, j) for _, i, s, e in a for _, j, u, v in b if e >= u and s <= v)


def _scattered(n, days, seed):
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(n):
        t = float(rng.uniform(0, days * 86400))
        one = lambda j: {"t": t + 60 * j, "gps": (10 + int(rng.integers(0, 20)) / 1000, 10.0) if rng.random() < 0.8 else None, "vector": rng.normal(size=4) if rng.random() < 0.8 else None, "activity": ["walk", "walking", "eat", "", "run"][rng.integers(0, 5)], "kind": "", "objects": {"ball"} if rng.random() < 0.1 else set(), "people": {str(rng.integers(0, 9))}}
        out[i] = [one(j) for j in range(int(rng.integers(1, 4)))]
    return out


def _brute_consolidation(found):
    """All pairs scored again before each merge."""
    live, into = {k: list(v) for k, v in found.items()}, {k: k for k in found}
    while True:
        best = None
        for a in sorted(live):
            for b in sorted(live):
                if a < b:
                    p = [events._Merged.of(0, live[k]) for k in (a, b)]
                    t = max(max(0, 1 - abs(x["t"] - y["t"]) / 21600) for x in live[a] for y in live[b])
                    loc = max([max(0, 1 - km(x["gps"], y["gps"])) for x in live[a] for y in live[b] if x["gps"] and y["gps"]], default=0.0)
                    sim = max([cos(x["vector"], y["vector"]) for x in live[a] for y in live[b] if x["vector"] is not None and y["vector"] is not None], default=0.0)
                    total = events.merge_total(t, loc, max(sim, 0.0), events._semantic(p[0].words, p[1].words), bool(p[0].people & p[1].people))
                    if total is not None and (best is None or total > best[0]):
                        best = (total, a, b)
        if best is None:
            return into
        _, a, b = best
        rank = lambda k: (len(live[k]), min(o["t"] for o in live[k]))
        target, source = (a, b) if rank(a) >= rank(b) else (b, a)
        live[target] += live.pop(source)
        into = {k: target if v == source else v for k, v in into.items()}


@pytest.mark.parametrize("seed", range(6))
def test_consolidation_by_heap_is_that_by_all_pairs(seed):
    found = _scattered(25, (0.5, 1, 4)[seed % 3], seed)
    assert events.consolidation(found) == _brute_consolidation(found)


def test_consolidation_of_many_events():
    """Work grows with near pairs: 5000 events of one scope take seconds."""
    import time

    began = time.perf_counter()
    into = events.consolidation(_scattered(5000, 250, 1))
    assert len(set(into.values())) < 4500 and time.perf_counter() - began < 30


def test_a_large_scope_is_parted_and_gives_the_same_clusters(spark, monkeypatch):
    """Folds of parts that no chain of near pairs connects are the fold of all."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12))
    rows = []
    for i in range(600):
        x = centres[rng.integers(0, 30)] + rng.normal(size=12) * 0.3
        rows.append((i, i % 2, x.tolist(), float(rng.integers(0, 10)) / 10, ["a", "b", "unknown"][rng.integers(0, 3)], "m", "n1" if i % 50 == 0 else None))
    df = spark.createDataFrame(rows, "id int, scope int, x array<double>, q double, pose string, model string, kept string").repartition(5)
    run = lambda: {r.id: r.cluster for r in clusters.cluster_by_quality(df, "scope", "id", "x", "q", "pose", "model", "kept", threshold=0.75).collect()}
    whole = run()
    monkeypatch.setattr(clusters, "MAX_FOLD", 100)
    monkeypatch.setattr(clusters, "PART_BLOCK", 70)
    assert run() == whole and 30 < len(set(whole.values())) < 600
    units = df.filter("scope = 0").withColumn("u", clusters.l2_normalised(F.col("x")))
    parts = {r.id: r.part for r in clusters.parted(units, ["scope"], "id", "u", 0.75).collect()}
    x = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows if r[1] == 0}
    root = {i: i for i in x}
    for _ in x:
        for i in x:
            for j in x:
                if x[i] @ x[j] >= 0.75:
                    root[i] = min(root[i], root[j])
        if all(root[i] == min(root[j] for j in x if x[i] @ x[j] >= 0.75) for i in x):
            break
    assert parts == root


def test_consolidation_streams_parts_and_leaves_lone_events_out(spark):
    """Events alone in their part never reach Python, and parts go on over the ends of batches."""
    rows = [(s, 100 * s + i, 60.0 * (i if i < 6 else 10_000 * i)) for s in range(20) for i in range(9)]
    seen = spark.createDataFrame(rows, "scope_id int, event_id int, s double").selectExpr(
        "scope_id", "event_id", "event_id AS obs_id", "timestamp_micros(cast(s * 1e6 AS bigint)) AS ts", "'k' AS kind", "'walk' AS activity", "array('o') AS objects", "array('u') AS people", "named_struct('lat', 1D, 'lon', 2D) AS gps", "array(1D, 0D) AS vector"
    )
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = events.consolidated(seen)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
        into = {r.event_id: r.into for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(into) == 180 and all((v % 100 == k % 100) if k % 100 >= 6 else (v // 100 == k // 100 and v % 100 < 6) for k, v in into.items())
    assert all(len({into[100 * s + i] for i in range(6)}) == 1 for s in range(20))
