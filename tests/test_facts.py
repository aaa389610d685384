"""Facts by confirmation, and merges that hang together, against plain models."""

import numpy as np
import pytest

from tessera import registry
from tessera.operators import clusters, entities

registry.load()
SF = "/root/testdata/sf0.001"


def plain_facts(assertions, confirmations=()):
    """(subject, value, id, at, confidence) and (id, at), one after the other: what is stored after all of them."""
    log = sorted([(at, 0, i, s, v, c) for s, v, i, at, c in assertions] + [(at, 1, i, None, None, None) for i, at in confirmations])
    facts, active = {}, {}
    for _, step, i, s, v, c in log:
        if step:
            if i in facts:
                s = facts[i]["subject"]
                facts[active[s]]["status"] = "superseded"
                facts[i]["status"], active[s] = "active", i
            continue
        now = facts.get(active.get(s))
        if now and now["value"] == v:
            now["evidence"].append(i)
            now["confidence"] = max(now["confidence"], c)
        else:
            facts[i] = {"subject": s, "value": v, "revision": now["revision"] + 1 if now else 1, "status": "pending" if now else "active", "supersedes": active.get(s), "confidence": c, "evidence": [i]}
            active.setdefault(s, i)
    return {i: (f["subject"], f["value"], f["revision"], f["status"], f["supersedes"], f["confidence"], f["evidence"]) for i, f in facts.items()}


def found(df):
    return {r.fact_id: (r[0], r.value, r.revision, r.status, r.supersedes, r.confidence, r.evidence_ids) for r in df.collect()}


def versions(spark, assertions, confirmations=None):
    rows = spark.createDataFrame(assertions, "subject string, value string, id int, at int, confidence double")
    asked = spark.createDataFrame(confirmations, "id int, at int") if confirmations is not None else None
    return found(entities.fact_versions(rows, ["subject"], "value", "id", "at", "confidence", asked))


def test_the_active_fact_stays_until_another_is_confirmed(spark):
    rows = [("child", "blocks", 1, 1, 0.8), ("child", "paint", 2, 2, 0.7), ("child", "blocks", 3, 3, 0.9)]
    want = {1: ("child", "blocks", 1, "active", None, 0.9, [1, 3]), 2: ("child", "paint", 2, "pending", 1, 0.7, [2])}
    assert versions(spark, rows) == want == plain_facts(rows)
    after = versions(spark, rows, [(2, 9)])
    assert after[1][3] == "superseded" and after[2][3] == "active" and after == plain_facts(rows, [(2, 9)])
    assert versions(spark, rows, [(3, 9), (77, 9), (2, 0)]) == want  # no facts, or none yet


def test_facts_by_the_plain_model(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{rng.integers(0, 6)}", "abc"[rng.integers(0, 3)], i, int(rng.integers(0, 40)), float(rng.integers(0, 9))) for i in range(300)]
    confirmed = [(int(rng.integers(0, 300)), int(rng.integers(0, 50))) for _ in range(40)]
    assert versions(spark, rows, confirmed) == plain_facts(rows, set(confirmed))
    assert versions(spark, rows, []) == versions(spark, rows) == plain_facts(rows)


def test_the_query(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    rows = [(r.user_id, r.event_type, r.event_id, r.ts.timestamp(), r.value) for r in events]
    confirmed = [(r.event_id, r.ts.timestamp() + 86400) for r in events if r.event_type == "purchase"]
    assert found(registry.QUERIES["fact_confirmations"](spark, SF)) == plain_facts(rows, confirmed)


def roots(spark, merges, order=None):
    schema = "source int, target int" + (", at int" if order else "")
    return {r.id: r.root for r in entities.canonical(spark.createDataFrame(merges, schema), order).collect()}


def test_chains_circles_and_stars(spark):
    assert roots(spark, [(1, 2), (2, 3), (5, 3), (7, 7)]) == {1: 3, 2: 3, 5: 3}
    assert roots(spark, [(i, i + 1) for i in range(200)]) == dict.fromkeys(range(200), 200)
    assert roots(spark, [(9, 4), (4, 6), (6, 9), (1, 9), (0, 1), (20, 21)]) == {9: 4, 4: 4, 6: 4, 1: 4, 0: 4, 20: 21}
    assert roots(spark, [(1, 3), (1, 2), (2, 3)]) == {1: 3, 2: 3} and roots(spark, [(1, 3, 1), (1, 2, 2)], "at") == {1: 3}
    assert roots(spark, []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_any_merges_end_where_walking_ends(spark, seed):
    rng = np.random.default_rng(seed)
    to = {int(a): int(b) for a, b in rng.integers(0, 60, (40, 2)) if a != b}
    want = {}
    for a in to:
        seen, at = [], a
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        want[a] = min(seen[seen.index(at) :]) if at in seen else at
    assert roots(spark, list(to.items())) == want


def test_edges_of_chains_meet_with_their_evidence(spark):
    edges = spark.createDataFrame([(1, 9, 0.2, ["a"]), (2, 9, 0.7, ["b", "a"]), (3, 2, 0.9, ["c"]), (4, 9, 0.1, ["d"])], "a int, b int, confidence double, evidence array<string>")
    merges = spark.createDataFrame([(1, 2), (2, 3)], "source int, target int")
    after = entities.remapped(edges, merges, ["a", "b"], "confidence", "evidence")
    assert {tuple(map(str, r)) for r in after.collect()} == {("3", "9", "0.7", "['a', 'b']"), ("4", "9", "0.1", "['d']")}


def test_operations_on_clusters_that_hang_together(spark):
    members = spark.createDataFrame([(i, i // 10) for i in range(70)], "sample int, cluster_id int")
    known = spark.createDataFrame([(i, "confirmed" if i == 5 else "pending", "ann" if i == 5 else None) for i in range(7)], "cluster_id int, status string, name string")
    ops = [("merge", 0, 1, None, None), ("merge", 1, 2, None, None), ("split", 1, 100, None, [11, 12]), ("merge", 100, 3, None, None), ("confirm", 2, None, "bob", None), ("confirm", 4, None, "ann", None), ("confirm", 6, None, "bob", None), ("reject", 3, None, None, None)]
    after, state = clusters.operated(members, known, spark.createDataFrame(ops, "op string, cluster_id int, target int, name string, samples array<int>"))
    home = {0: 2, 1: 2, 2: 2, 3: None, 4: 5, 5: 5, 6: 2}
    assert {r.sample: r.cluster_id for r in after.collect()} == {i: None if i in (11, 12) else home[i // 10] for i in range(70)}
    assert {r.cluster_id: (r.status, r.name) for r in state.collect()} == {0: ("rejected", None), 1: ("rejected", None), 2: ("confirmed", "bob"), 3: ("rejected", None), 4: ("rejected", None), 5: ("confirmed", "ann"), 6: ("rejected", None), 100: ("rejected", None)}


def test_merged_events_rebuild_their_participants(spark):
    events = spark.createDataFrame([(1, 5, 6, None, "walk", 0.4, 1), (2, 3, 4, "park", None, 0.9, 1), (3, 8, 9, "home", "eat", 0.1, 4)], "event_id int, start_ts int, end_ts int, place string, activity string, confidence double, revision int")
    seen = spark.createDataFrame([(1, "o1"), (2, "o2"), (3, "o3")], "event_id int, obs_id string")
    people = spark.createDataFrame([("o1", "p", 0.5), ("o2", "p", 0.8), ("o2", "q", 0.3), ("o3", "q", 0.6)], "obs_id string, person_id string, confidence double")
    after, obs, parts = entities.merged_events(events, seen, people, spark.createDataFrame([(2, 1), (3, 2)], "source int, target int"))
    assert [tuple(r) for r in after.collect()] == [(1, 3, 9, "park", "walk", 0.9, 3)]
    assert {tuple(r) for r in obs.collect()} == {(1, "o1"), (1, "o2"), (1, "o3")}
    assert {tuple(map(str, r)) for r in parts.collect()} == {("1", "p", "0.8", "['o1', 'o2']"), ("1", "q", "0.6", "['o2', 'o3']")}


@pytest.mark.parametrize("seed", range(3))
def test_connected(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {i: r for i, r in root.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert {r.id: r.root for r in entities.connected(spark.createDataFrame(edges, "a int, b int")).collect()} == want
