"""What is asserted of people and things, and how it changes: names, claims, properties, relations, evidence, gaps.

Changes come as logs (a row for each assertion, with an order `at`); the state after a log is an aggregate or a window over
it, so nothing is read and written row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_in_order(values: Column) -> Column:
    """Values of array<struct<at, v>> without repeats, each where it came first."""
    return F.array_distinct(F.transform(F.array_sort(values), lambda x: x["v"]))


def person_assets(paths: list[DataFrame]) -> DataFrame:
    """person_id, asset_id and over how many paths (faces, mentions) a person is known to be in an asset. paths: person_id, asset_id."""
    named = [p.select("person_id", "asset_id", F.lit(i).alias("path")) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, named).groupBy("person_id", "asset_id").agg(F.countDistinct("path").alias("paths"))


def person_events(mentions: DataFrame, bridge: DataFrame, events: DataFrame) -> DataFrame:
    """person_id, event_id, start_ts and ordinal: each person's events in order of time.

    mentions: person_id, obs_id. bridge: obs_id, event_id. events: event_id, start_ts.
    """
    found = mentions.join(bridge, "obs_id").select("person_id", "event_id").distinct().join(events.select("event_id", "start_ts"), "event_id")
    return found.withColumn("ordinal", F.row_number().over(W.partitionBy("person_id").orderBy("start_ts", "event_id")))


def resolved_names(asked: DataFrame, people: DataFrame) -> DataFrame:
    """asked (scope_id, name) with person_id and via_alias: by canonical name, else by alias; the smallest id of several.

    people: scope_id, person_id, name, aliases (array).
    """
    name = F.trim("name")
    exact = people.select("scope_id", name.alias("__n"), "person_id", F.lit(0).alias("via"))
    alias = people.select("scope_id", F.explode("aliases").alias("__n"), "person_id", F.lit(1).alias("via"))
    best = exact.unionByName(alias).groupBy("scope_id", "__n").agg(F.min(F.struct("via", "person_id")).alias("b"))
    rows = asked.withColumn("__n", name).join(best, ["scope_id", "__n"], "left")
    return rows.select("scope_id", "name", F.col("b.person_id").alias("person_id"), (F.col("b.via") == 1).alias("via_alias"))


def ordered_by_type(entities: DataFrame, kind: str, types: list[str], then: list[str]) -> DataFrame:
    """entities with ordinal, in a given order of their types; types that aren't listed come last."""
    place = reduce(lambda acc, t: F.when(F.col(kind) == t, types.index(t)).otherwise(acc), types, F.lit(len(types)))
    return entities.withColumn("type_place", place).withColumn("ordinal", F.row_number().over(W.partitionBy("type_place").orderBy(*then)))


# Predicates that mean the same, and dimensions that hold several values at a time.
PREDICATES = {"参加过": "参与", "参加": "参与", "出席": "参与", "出现于": "出现在", "位于": "出现在", "拍摄了": "拍摄", "拍照": "拍摄", "家庭成员角色": "家庭角色"}
MULTI_VALUED = ("activity", "place", "clothing", "capture", "attendance")


def claims(log: DataFrame, predicates: dict[str, str] = PREDICATES, multi: tuple[str, ...] = MULTI_VALUED) -> DataFrame:
    """The claims that a log of assertions leaves: one for each person, dimension, predicate and value.

    log: person_id, dimension, predicate, value, event_id, evidence_id, confidence, at. Equal assertions merge (evidence and
    events in order, highest confidence). Of several values the first is active and the others are pending revisions of it,
    but in dimensions that hold several all are active.
    """
    common = F.trim("predicate")
    for said, meant in predicates.items():
        common = F.when(F.trim("predicate") == said, meant).otherwise(common)
    rows = log.withColumn("predicate", common).withColumn("value", F.trim("value"))
    keys = ["person_id", "dimension", "predicate"]
    held = lambda c: F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("v"))))
    merged = rows.groupBy(*keys, "value").agg(F.min("at").alias("at"), F.max("confidence").alias("confidence"), distinct_in_order(held("evidence_id")).alias("evidence"), distinct_in_order(held("event_id")).alias("events"))
    first = F.first("value").over(W.partitionBy(*keys).orderBy("at", "value"))
    pending = (F.col("value") != first) & ~F.col("dimension").isin(*multi)
    merged = merged.withColumn("supersedes", F.when(pending, first)).withColumn("status", F.when(pending, "pending").otherwise("active")).withColumn("revision", F.when(pending, 2).otherwise(1))
    return merged.withColumn("support", F.greatest(F.lit(1), F.size("events"))).drop("at")


def properties(log: DataFrame) -> DataFrame:
    """The versions of each entity's properties that a log of values leaves.

    log: entity_id, key, value, source (user or derived), confidence, evidence_id, at. A user's value is current at once and
    supersedes what was; later derived values don't touch it. Among derived ones the first is active, equal ones add to it,
    and each other one is a pending revision of it.
    """
    w = W.partitionBy("entity_id", "key").orderBy("at")
    by_user = F.col("source") == "user"
    users = F.sum(by_user.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = log.withColumn("users", users).filter(by_user | (F.col("users") == 0))
    rows = rows.withColumn("first", F.first("value").over(w)).withColumn("same", ~by_user & (F.col("value") == F.col("first")) & (F.col("users") == 0))
    # Equal derived values are one version, at the place of the first.
    version = F.when(F.col("same"), F.lit("first")).otherwise(F.col("at").cast("string"))
    versions = rows.withColumn("version", version).groupBy("entity_id", "key", "version").agg(
        F.min("at").alias("at"), F.min_by("value", "at").alias("value"), F.min_by("source", "at").alias("source"), F.max("confidence").alias("confidence"), F.max("users").alias("users"),
        distinct_in_order(F.collect_list(F.struct("at", F.col("evidence_id").alias("v")))).alias("evidence"),
    )
    whole = W.partitionBy("entity_id", "key")
    last, derived = F.max("users").over(whole), F.max((F.col("source") != "user").cast("int")).over(whole)
    user = F.col("source") == "user"
    status = F.when(user & (F.col("users") == last), "active").when(last > 0, "superseded").when(F.col("version") == "first", "active").otherwise("pending")
    revision = F.when(user, F.col("users") + derived).when(F.col("version") == "first", 1).otherwise(2)
    return versions.select("entity_id", "key", "value", "source", "confidence", "evidence", status.alias("status"), revision.cast("int").alias("revision"), "at")


def merged_values(log: DataFrame) -> DataFrame:
    """entity_id, key and values: all that a property that holds several values has, in order, without repeats."""
    return log.filter("value <> ''").groupBy("entity_id", "key").agg(distinct_in_order(F.collect_list(F.struct("at", F.col("value").alias("v")))).alias("values"))


def relations(log: DataFrame) -> DataFrame:
    """The state of each relation after a log of assert, confirm and retract.

    log: subject, predicate, object, action, confidence, evidence_id, at. The last confirm or retract decides; an assertion
    after a retraction makes it a candidate again; confidence is the highest, evidence merges.
    """
    keys = ["subject", "predicate", "object"]
    decided = F.max_by("action", "at")
    found = log.groupBy(*keys).agg(
        decided.alias("last"), F.max_by("action", F.when(F.col("action") != "assert", F.col("at"))).alias("verdict"), F.max("confidence").alias("confidence"),
        distinct_in_order(F.collect_list(F.when(F.col("evidence_id").isNotNull(), F.struct("at", F.col("evidence_id").alias("v"))))).alias("evidence"), F.count_if(F.col("action") != "assert").alias("verdicts"),
    )
    status = F.when(F.col("verdicts") == 0, "candidate").when((F.col("verdict") == "retract") & (F.col("last") == "assert"), "candidate").when(F.col("verdict") == "retract", "retracted").otherwise("confirmed")
    return found.select(*keys, status.alias("status"), "confidence", "evidence")


def rehomed(entities: DataFrame, evidence: DataFrame, mapping: dict[str, str], vocabulary: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Legacy labels brought into a vocabulary: entities (scope_id, name) with target, and their evidence edges moved.

    A label whose common form is in the vocabulary goes to that entity with all its evidence, of which the highest confidence
    stays; others are retired, and so are their edges. evidence: scope_id, name, obs_id, confidence.
    """
    form = F.trim("name")
    for said, meant in mapping.items():
        form = F.when(F.trim("name") == said, meant).otherwise(form)
    target = F.when(form.isin(*vocabulary), form)
    moved = evidence.withColumn("target", target).filter("target IS NOT NULL").groupBy("scope_id", "target", "obs_id").agg(F.max("confidence").alias("confidence"))
    return entities.withColumn("target", target).withColumn("status", F.when(target.isNull(), "retired").otherwise("normalised")), moved


def entity_evidence(mentions: DataFrame, observations: DataFrame) -> DataFrame:
    """Per entity: observations, assets and events that show it, first and last time, and the latest observation.

    mentions: entity_id, obs_id. observations: obs_id, asset_id, event_id, ts.
    """
    rows = mentions.select("entity_id", "obs_id").distinct().join(observations, "obs_id")
    return rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("asset_id").alias("assets"), F.countDistinct("event_id").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(F.struct("ts", "obs_id"))["obs_id"].alias("latest"))


def renamed(log: DataFrame) -> DataFrame:
    """entity_id, name and aliases after a log of names (entity_id, name, at): the last name, the earlier ones as aliases in order."""
    rows = log.groupBy("entity_id").agg(F.max_by("name", "at").alias("name"), distinct_in_order(F.collect_list(F.struct("at", F.col("name").alias("v")))).alias("all_names"))
    return rows.select("entity_id", "name", F.filter("all_names", lambda x: x != F.col("name")).alias("aliases"))


def appearance_evidence(log: DataFrame, mentions: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The last record of each person, face and model, for confirmed persons to whom the face belongs, with rank by confidence.

    log: person_id, face_id, model, clothing (array), confidence, at. mentions: person_id, face_id. confirmed: person_id.
    """
    allowed = log.join(mentions.select("person_id", "face_id").distinct(), ["person_id", "face_id"], "left_semi").join(confirmed.select("person_id"), "person_id", "left_semi")
    last = allowed.groupBy("person_id", "face_id", "model").agg(F.max(F.struct("at", "confidence", "clothing")).alias("r"))
    rows = last.select("person_id", "face_id", "model", F.array_distinct(F.filter(F.transform("r.clothing", lambda x: F.trim(x)), lambda x: x != "")).alias("clothing"), F.col("r.confidence").alias("confidence"), F.col("r.at").alias("at"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("person_id").orderBy(F.desc("confidence"), F.desc("at"), "face_id", "model")))


def gap_states(gaps: DataFrame, feedback: DataFrame) -> DataFrame:
    """gaps (gap_id) with status and resolution: resolved by its last feedback (gap_id, correction, accepted, at), else open."""
    last = feedback.groupBy("gap_id").agg(F.max_by(F.coalesce("correction", "accepted", F.lit("confirmed")), "at").alias("resolution"))
    return gaps.join(last, "gap_id", "left").withColumn("status", F.when(F.col("resolution").isNull(), "open").otherwise("resolved"))


#: Keys that a dialogue's state may hold.
STATE_KEYS = ("scope_id", "active_event_ids", "active_entity_ids", "evidence_ids", "unresolved_ambiguity")


def dialogue_states(log: DataFrame, keys: tuple[str, ...] = STATE_KEYS) -> DataFrame:
    """conversation_id and its last state: of the JSON object (column state) only allowed keys, each as text."""
    last = log.groupBy("conversation_id").agg(F.max_by("state", "at").alias("state"))
    return last.select("conversation_id", *[F.get_json_object("state", f"$.{k}").alias(k) for k in keys])


def profile_text(rows: DataFrame, person: str, value: str, order: str, most: int = 3) -> DataFrame:
    """Per person the most common values as text; of equally common ones those that came first."""
    counts = rows.groupBy(person, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy(person).orderBy(F.desc("n"), "at", value))).filter(F.col("r") <= most)
    return ranked.groupBy(person).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda x: x["v"].cast("string")), "、").alias("profile"))


def matched_topics(observations: DataFrame, wanted: str, topics: Column, most: int = 20) -> DataFrame:
    """Topics of observations whose text matches, by number of events (an observation without one counts as its own); the top ones.

    observations: obs_id, event_id, text, and what `topics` (an array column) reads.
    """
    event = F.coalesce(F.col("event_id").cast("string"), F.concat(F.lit("obs:"), F.col("obs_id").cast("string")))
    each = observations.filter(F.col("text").rlike(wanted)).select(event.alias("event"), F.explode(F.array_distinct(topics)).alias("topic"))
    return each.groupBy("topic").agg(F.countDistinct("event").alias("events")).orderBy(F.desc("events"), "topic").limit(most)


def person_summary(rows: DataFrame, participants: DataFrame, places: int = 8, companions: int = 10) -> DataFrame:
    """Per person: assets, events, first and last time, most frequent places and most frequent companions.

    rows: person_id, asset_id, event_id, ts, place. participants: event_id, person_id.
    """
    base = rows.groupBy("person_id").agg(F.countDistinct("asset_id").alias("assets"), F.countDistinct("event_id").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

    def top(counts: DataFrame, what: str, k: int, name: str) -> DataFrame:
        ranked = counts.withColumn("r", F.row_number().over(W.partitionBy("person_id").orderBy(F.desc("n"), what))).filter(F.col("r") <= k)
        return ranked.groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(what).alias("v")))), lambda x: x["v"].cast("string")), ",").alias(name))

    where = rows.filter("place IS NOT NULL").groupBy("person_id", "place").agg(F.countDistinct("asset_id").alias("n"))
    members = participants.select("event_id", "person_id").distinct()
    others = members.withColumnRenamed("person_id", "other")
    with_ = members.join(others, "event_id").filter("person_id <> other").groupBy("person_id", "other").agg(F.count(F.lit(1)).alias("n"))  # an event bounds its pairs
    return base.join(top(where, "place", places, "places"), "person_id", "left").join(top(with_, "other", companions, "companions"), "person_id", "left")


def groups_with_members(entities: DataFrame, keys: list[str], name: str, weight: str, confidence: str) -> DataFrame:
    """Groups of entities: sum of a weight, highest confidence, and members by falling weight, then name. A group bounds its list."""
    member = F.struct((-F.col(weight)).alias("w"), F.col(name).alias("name"))
    found = entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.sum(weight).alias("total"), F.max(confidence).alias("confidence"), F.array_sort(F.collect_list(member)).alias("m"))
    return found.withColumn("names", F.array_join(F.transform("m", lambda x: x["name"]), ",")).drop("m")


def merge_objects(old: Column, new: Column) -> Column:
    """Two JSON objects of strings as one, the second's values winning; what is no object counts as empty."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(read(old), lambda k, _: ~F.map_contains_key(read(new), k))
    return F.map_concat(kept, read(new))


def json_list(text: Column) -> Column:
    """A JSON array of strings; null, broken or other JSON is an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def canonical_distinct(values: Column) -> Column:
    """JSON values without repeats, compared by canonical form (keys sorted, no spaces), each where it came first."""
    canon = lambda v: F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(v, "map<string,string>"))))), F.trim(v))
    return F.array_distinct(F.transform(values, canon))


def allowed_columns(rows: DataFrame, allowed: dict[str, tuple[str, ...]], tool: str) -> DataFrame:
    """The columns that a tool may show, in the list's order; an unknown tool may show none of them."""
    return rows.select(*[c for c in allowed.get(tool, ()) if c in rows.columns])


def group_keys(label: Column, primary: Column, exact: dict[str, str], parts: dict[str, str], concept: Column) -> Column:
    """The key by which labels are grouped: what is given, else an equivalent word, else one for a part of it, else concept, else itself."""
    word = F.lower(F.trim(label))
    out = F.coalesce(F.when(F.trim(concept) != "", F.trim(concept)), word)
    for part, key in reversed(list(parts.items())):
        out = F.when(F.contains(word, F.lit(part)), key).otherwise(out)
    for same, key in exact.items():
        out = F.when(word == same, key).otherwise(out)
    return F.coalesce(F.when(F.trim(primary) != "", F.trim(primary)), out)
