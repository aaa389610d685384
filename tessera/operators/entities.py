"""Entities and their graph: co-occurrence, patterns, versioned facts, merges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalog import small, written


def cooccurrence(participants: DataFrame, event: str, person: str) -> DataFrame:
    """a < b, shared events and confidence min(0.9, 0.45 + 0.1 n) of all pairs that share an event.

    The pairs of one event are the product of its own participants, which an event bounds; nothing else is paired.
    """
    rows = participants.select(F.col(event).alias("__e"), F.col(person).alias("a")).distinct()
    pairs = rows.join(rows.withColumnRenamed("a", "b"), "__e").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.withColumn("confidence", F.least(F.lit(0.9), F.lit(0.45) + 0.1 * F.col("shared")))


def companions(participants: DataFrame, event: str, person: str, who, k: int) -> DataFrame:
    """The k that share most events with one; ties by id."""
    mine = participants.filter(F.col(person) == who).select(event).distinct()
    others = participants.filter(F.col(person) != who).select(event, person).distinct().join(mine, event, "left_semi")
    return others.groupBy(person).agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), person).limit(k)


def patterns(rows: DataFrame, person: str, kind: str, value: str, event: str, ts: str, confidence: str) -> DataFrame:
    """Per person, kind and normalised value: support, first and last seen, highest confidence."""
    keyed = rows.withColumn("pattern_value", F.lower(F.trim(value)))
    return keyed.groupBy(person, kind, "pattern_value").agg(F.countDistinct(event).alias("support"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.max(confidence).alias("confidence"))


def fact_versions(assertions: DataFrame, subject: list[str], value: str, fact: str, at: str, confidence: str, confirmations: DataFrame | None = None) -> DataFrame:
    """Versions of facts, by the rule that an active one stays until somebody confirms another.

    The first assertion of a subject is its active fact, revision 1. An assertion that says what the active fact says adds to its
    evidence and may raise its confidence; any other is a pending fact of its own, one revision above the active one, which it
    would supersede. A confirmation (fact, at) makes that fact active, and the one that was active superseded; one of an id that
    is no fact, or of a fact that comes later, changes nothing. Assertions (ids in the column `fact`) come by time, then id, and
    before confirmations of their time.

    subject, fact_id, value, revision, status, supersedes, confidence, evidence_ids (ids of the assertions, in order). Subjects
    without confirmations need no fold: their active fact is the first. Only the others are folded, a row at a time, with the
    active fact as state.
    """
    rows = assertions.select(*subject, F.col(value).alias("value"), F.col(fact).alias("id"), F.col(at).alias("at"), F.col(confidence).alias("confidence"))
    if confirmations is None:
        return _versions(rows.select("*", *_against_first(subject)), subject)
    asked = confirmations.select(F.col(fact).alias("id"), F.col(at).alias("confirmed_at"))
    named = rows.join(asked, "id").select(*subject, "id", F.col("confirmed_at").alias("at"))
    folded = named.select(*subject).distinct()
    simple = rows.join(folded, subject, "left_anti").select("*", *_against_first(subject))
    log = rows.join(folded, subject, "left_semi").withColumn("step", F.lit(0)).unionByName(named.withColumn("step", F.lit(1)), allowMissingColumns=True)
    log = log.withColumn("wanted", F.max("step").over(W.partitionBy(*subject, "id")) == 1)
    return _versions(simple, subject).unionByName(_versions(_against_confirmed(log, subject, rows), subject))


_MEMBER = ["of", "revision", "supersedes", "was_active", "is_active"]


def _against_first(subject: list[str]) -> list[Column]:
    """What each assertion becomes where the first one stays active."""
    first = F.min(F.struct("at", "id", "value")).over(W.partitionBy(*subject))
    own = F.col("value").eqNullSafe(first["value"])
    pending = lambda c: F.when(~own, c)
    return [F.when(own, first["id"]).otherwise(F.col("id")).alias("of"), F.when(own, F.lit(1)).otherwise(F.lit(2)).cast("long").alias("revision"), pending(first["id"]).alias("supersedes"), own.alias("was_active"), own.alias("is_active")]


def _against_confirmed(log: DataFrame, subject: list[str], rows: DataFrame) -> DataFrame:
    """The same for subjects with confirmations: a fold over their assertions and confirmations in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, active, facts = None, None, {}
        for b in batches:
            out = []
            for *key, i, value, step, wanted in zip(*[b[c] for c in subject], b["id"], b["value"], b["step"], b["wanted"]):
                if who != key:
                    who, active, facts = key, None, {}
                if step:  # a confirmation
                    of = facts.get(i)
                    active = of or active
                elif active is None or value == active[1] or (value is None and active[1] is None):
                    active = active or (i, value, 1, None)
                    of = active
                else:
                    of = (i, value, active[2] + 1, active[0])
                if of and wanted and of[0] == i:
                    facts[i] = of
                out.append((*((of[0], of[2], of[3]) if of else (None, None, None)), active[0] if active else None))
            got = pd.DataFrame(out, columns=["of", "revision", "supersedes", "now"], dtype=object)
            yield pd.concat([b.drop(columns=["wanted"]).reset_index(drop=True), got], axis=1)

    types = {f.name: f.dataType.simpleString() for f in log.schema}
    fields = ", ".join(f"`{c}` {types[c]}" for c in log.columns if c != "wanted")
    ordered = log.repartition(*subject).sortWithinPartitions(*subject, "at", "step", "id")
    found = ordered.mapInPandas(run, f"{fields}, of {types['id']}, revision long, supersedes {types['id']}, now {types['id']}")
    last = F.max(F.struct("at", "step", "id", "now")).over(W.partitionBy(*subject))["now"]
    was = F.max((F.col("now") == F.col("of")).cast("int")).over(W.partitionBy(*subject, "of")) == 1
    found = found.withColumn("is_active", F.col("of") == last).withColumn("was_active", was)
    return found.filter("step = 0").select(*rows.columns, *_MEMBER)


def _versions(members: DataFrame, subject: list[str]) -> DataFrame:
    """A row a fact, from assertions that know which fact they belong to."""
    status = F.when(F.col("is_active"), "active").when(F.col("was_active"), "superseded").otherwise("pending")
    own = lambda c: F.max(F.when(F.col("id") == F.col("of"), F.col(c)))
    facts = members.groupBy(*subject, F.col("of").alias("fact_id")).agg(
        own("value").alias("value"), own("revision").alias("revision"), F.max(status).alias("status"), own("supersedes").alias("supersedes"), F.max("confidence").alias("confidence"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda e: e["id"]).alias("evidence_ids"),
    )
    return facts


def without_subject(facts: DataFrame, fact_key: str, entities: DataFrame, entity_key: str) -> DataFrame:
    """Facts whose subject is no entity (any more)."""
    return facts.join(entities.select(F.col(entity_key).alias("__k")), F.col(fact_key) == F.col("__k"), "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old and new rows with the last of each key by order."""
    rows = old.unionByName(new, allowMissingColumns=True)
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def find_or_create(mentions: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """Distinct entities of mentions with a deterministic id and their highest confidence."""
    made = mentions.groupBy(*keys).agg(F.max(confidence).alias("confidence"), F.count(F.lit(1)).alias("mentions"))
    return made.withColumn("entity_id", F.concat(F.lit("entity_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256), 1, 12)))


def canonical(merges: DataFrame, order: str | None = None) -> DataFrame:
    """id and root of everything that was merged (source into target), through chains of any length.

    Of several merges of one source the first by `order` holds (without it, that into the smallest target). What was merged in a
    circle has the smallest of the circle as its root. Pointers double in length with every round, so there are as many rounds
    as the logarithm of the longest chain.
    """
    rank = [F.col(order).asc(), F.col("target").asc()] if order else [F.col("target").asc()]
    one = F.row_number().over(W.partitionBy("source").orderBy(*rank))
    at = merges.filter("source <> target").withColumn("__n", one).filter("__n = 1")
    at = written(at.select("source", "target", F.col("target").alias("low"), F.lit(False).alias("done")), "merges")
    steps, n = 1, at.count()
    while True:
        ahead = at.select(F.col("source").alias("__s"), F.col("target").alias("__t"), F.col("low").alias("__l"), F.col("done").alias("__d"))
        on = at.join(ahead, at["target"] == ahead["__s"], "left")
        ends = F.col("done") | F.col("__s").isNull()
        at = written(on.select("source", F.when(ends, F.col("target")).otherwise(F.col("__t")).alias("target"), F.when(ends, F.col("low")).otherwise(F.least("low", "__l")).alias("low"), (ends | F.col("__d")).alias("done")), "merges")
        steps *= 2
        if at.filter("NOT done").isEmpty():
            return at.select(F.col("source").alias("id"), F.col("target").alias("root"))
        if steps > 2 * n:  # who is still under way goes round in a circle, as does the target of such a one
            low = at.select(F.col("source").alias("__s"), F.col("low").alias("__low"))
            on = at.join(low, at["target"] == low["__s"], "left")
            return on.select(F.col("source").alias("id"), F.when(F.col("done"), F.col("target")).otherwise(F.col("__low")).alias("root"))


def connected(edges: DataFrame) -> DataFrame:
    """id and root (the smallest that can be reached) of all ends of edges (a, b).

    Each round hangs every node, and what it is linked to, on the least of its neighbours, then follows the nodes to where
    they hang; edges inside a tree go. Sides of joins are written, so that a node with very many edges can be split.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    homes = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "homes")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("source")).agg(F.min("b").alias("target")).filter("target < source")
        hung = small(written(canonical(least), "hung"))  # chains of ever smaller nodes, so without circles
        homes = homes.join(hung.withColumnRenamed("id", "__s").withColumnRenamed("root", "__r"), F.col("root") == F.col("__s"), "left")
        homes = written(homes.select("id", F.coalesce("__r", "root").alias("root")), "homes")
        for end in ("a", "b"):
            edges = edges.join(hung.withColumnRenamed("id", "__s").withColumnRenamed("root", "__r"), edges[end] == F.col("__s"), "left").withColumn(end, F.coalesce("__r", end)).drop("__s", "__r")
        edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return homes


def remapped(edges: DataFrame, merges: DataFrame, ends: list[str], confidence: str | None = None, evidence: str | None = None, order: str | None = None) -> DataFrame:
    """Edges with merged entities (source, target) redirected to what they have become in the end; self-loops go.

    Equal edges become one, with the highest confidence and all evidence (an array column), where these are named.
    """
    out, roots = edges, canonical(merges, order)
    roots = small(written(roots.select(F.col("id").alias("__s"), F.col("root").alias("__t")), "roots"))
    for end in ends:
        out = out.join(roots, out[end] == F.col("__s"), "left").withColumn(end, F.coalesce("__t", end)).drop("__s", "__t")
    if len(ends) == 2:
        out = out.filter(F.col(ends[0]) != F.col(ends[1]))
    if not confidence and not evidence:
        return out.distinct()
    extra = [F.max(confidence).alias(confidence)] if confidence else []
    extra += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(evidence)))).alias(evidence)] if evidence else []
    return out.groupBy(*[c for c in edges.columns if c not in (confidence, evidence)]).agg(*extra)


def merged_events(events: DataFrame, observations: DataFrame, mentions: DataFrame, merges: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events after merges (source, target), their observations, and their participants rebuilt from those.

    events: event_id, start_ts, end_ts, place, activity, confidence, revision. observations: event_id, obs_id. mentions: obs_id,
    person_id, confidence. An event that takes in others spans all of them, keeps its own place and activity (else that of the
    first of them by id), has the highest confidence, and a revision more for each. participants: event_id, person_id,
    confidence (highest), evidence_ids (its observations in order).
    """
    roots = small(written(canonical(merges, order), "roots"))
    homed = lambda rows: rows.join(roots, rows["event_id"] == roots["id"], "left").withColumn("__home", F.coalesce("root", "event_id")).drop("id", "root")
    rows = homed(events).withColumn("__rank", F.struct((F.col("event_id") != F.col("__home")), "event_id"))
    own = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("__rank", c)))[c].alias(c)
    kept = F.max(F.when(F.col("event_id") == F.col("__home"), F.col("revision"))) + F.count(F.lit(1)) - 1
    after = rows.groupBy(F.col("__home").alias("event_id")).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), own("place"), own("activity"), F.max("confidence").alias("confidence"), kept.alias("revision"))
    seen = homed(observations).select(F.col("__home").alias("event_id"), "obs_id").distinct()
    people = seen.join(mentions, "obs_id").groupBy("event_id", "person_id").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("obs_id")).alias("evidence_ids"))
    return after, seen, people


def merge_candidates(entities: DataFrame, group: str, key: str, types: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Groups of at least two entities of one type (of all types, or of the allowed ones) that share a grouping key, members in order."""
    kept = entities if allowed is None else entities.filter(F.col(types).isin(*allowed))
    found = kept.groupBy(types, group).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("keep"))
    return found.filter("n >= 2")


def access_priority(log: DataFrame, item: str, ts: str, conversation: str, now: Column, days: int = 30) -> DataFrame:
    """Accesses and distinct conversations of the last days; priority from 3 accesses in 2 conversations on."""
    recent = log.filter(F.col(ts) >= now - F.make_interval(days=F.lit(days)))
    counted = recent.groupBy(item).agg(F.count(F.lit(1)).alias("accesses"), F.countDistinct(conversation).alias("conversations"))
    return counted.withColumn("priority", (F.col("accesses") >= 3) & (F.col("conversations") >= 2))
