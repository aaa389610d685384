"""Lifecycle as pure transforms: what a mutation leaves behind is a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.entities import upserted
from tessera.operators.sequences import first_per_group as latest_per_key


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest vector of each (space, source_type, source_id, model_name)."""
    return upserted(old, new, ["space", "source_type", "source_id", "model_name"], [F.desc("updated_at")])


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table (with its foreign key) without the rows of deleted keys."""
    keys = gone.select(F.col(key).alias("__k")).distinct()
    return {name: df.join(keys, df[fk] == keys["__k"], "left_anti") for name, (df, fk) in tables.items()}


def orphans(files: DataFrame, file_key: str, assets: DataFrame, asset_key: str) -> DataFrame:
    """Files that no asset refers to."""
    return files.join(assets.select(F.col(asset_key).alias("__k")).distinct(), F.col(file_key) == F.col("__k"), "left_anti")


def current(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest revision of each key."""
    return latest_per_key(revisions, keys, [F.desc("revision")])


def apply_corrections(revisions: DataFrame, proposals: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Revisions and one new one for each proposal that is unexpired and was made on the current revision; applying twice changes nothing.

    proposals: the keys, token, base_revision, value, expires_at.
    """
    latest = current(revisions, keys).select(*keys, F.col("revision").alias("__r"))
    good = proposals.filter(F.col("expires_at") > now).join(latest, keys).filter(F.col("base_revision") == F.col("__r"))
    one = latest_per_key(good, keys, [F.asc("token")])
    added = one.select(*keys, "value", (F.col("__r") + 1).alias("revision"))
    return revisions.select(*keys, "value", "revision").unionByName(added)


def invalidated(items: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Items with stale: made from a revision of their source (key, revision) that is no longer its latest."""
    latest = sources.groupBy(key).agg(F.max("revision").alias("__r"))
    return items.join(latest, key, "left").withColumn("stale", F.coalesce(F.col("revision") < F.col("__r"), F.lit(False))).drop("__r")


def demoted(items: DataFrame, ts: str, now: Column, days: int = 90) -> DataFrame:
    """Items with status `stale` where they were last used more than so many days ago."""
    return items.withColumn("status", F.when(F.col(ts) < now - F.make_interval(days=F.lit(days)), "stale").otherwise(F.col("status")))


def majority_model(vectors: DataFrame) -> DataFrame:
    """Vectors of each space's most frequent model and, among those, of its most frequent dimension."""
    counts = vectors.groupBy("space", "model_name", F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    models = latest_per_key(counts.groupBy("space", "model_name").agg(F.sum("n").alias("n")), ["space"], [F.desc("n"), F.asc("model_name")]).select("space", "model_name")
    dims = latest_per_key(counts.join(models, ["space", "model_name"]), ["space"], [F.desc("n"), F.asc("dim")]).select("space", "model_name", "dim")
    kept = vectors.withColumn("dim", F.size("vector")).join(dims, ["space", "model_name", "dim"], "left_semi")
    return kept.drop("dim")


def open_gaps(log: DataFrame, key: str, ts: str) -> DataFrame:
    """Query gaps whose latest status is open."""
    return latest_per_key(log, [key], [F.desc(ts)]).filter("status = 'open'")


def without_derivatives(tables: dict[str, tuple[DataFrame, str]], bridge: DataFrame, events: DataFrame, failed: DataFrame) -> dict[str, DataFrame]:
    """What is left when the derivatives of failed assets go: their observations' rows in every table, and events left without any.

    tables: name to (rows, column of the observation). bridge: obs_id, event_id. failed: obs_id.
    """
    gone = failed.select(F.col("obs_id").alias("__o"))
    out = {name: rows.join(gone, rows[column] == gone["__o"], "left_anti") for name, (rows, column) in tables.items()}
    left = bridge.join(gone, bridge["obs_id"] == gone["__o"], "left_anti")
    emptied = bridge.select("event_id").distinct().join(left.select("event_id"), "event_id", "left_anti")
    return out | {"bridge": left, "events": events.join(emptied, "event_id", "left_anti")}


def with_columns(rows: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """rows with the columns of a later schema that they lack, at their defaults; columns that are there stay as they are."""
    missing = [F.lit(default).cast(kind).alias(name) for name, (kind, default) in schema.items() if name not in rows.columns]
    return rows.select("*", *missing)


def revisions(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """An audit row for every column that a change of a row changes: key, field, before and after (as text)."""
    each = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select(key, "x.field", F.col("x.v").alias(name))
    both = each(old, "before").join(each(new, "after"), [key, "field"])
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def candidate_states(candidates: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Candidates (key) after decisions (key, action, at): status by the last confirm or reject, revision 1 and one more for each; deleted ones go."""
    last = decisions.groupBy(key).agg(F.max_by("action", "at").alias("last"), F.count_if(F.col("action").isin("confirm", "reject")).alias("n"), F.max_by("action", F.when(F.col("action") != "delete", F.col("at"))).alias("verdict"))
    rows = candidates.join(last, key, "left").filter(F.coalesce(F.col("last") != "delete", F.lit(True)))
    status = F.when(F.col("verdict") == "confirm", "confirmed").when(F.col("verdict") == "reject", "rejected").otherwise("pending")
    return rows.select(key, status.alias("status"), (F.coalesce("n", F.lit(0)) + 1).alias("revision"))


def to_rebuild(sources: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Keys whose derived row is missing or older than its source (columns key, revision): what a backfill has to make."""
    d = derived.groupBy(key).agg(F.max("revision").alias("__done"))
    return sources.join(d, key, "left").filter(F.col("__done").isNull() | (F.col("__done") < F.col("revision"))).select(key, F.when(F.col("__done").isNull(), "missing").otherwise("stale").alias("reason"))


def unexpired(rows: DataFrame, created: str, now: Column, hours: float) -> DataFrame:
    """rows that were made less than so many hours ago: results live a day, tokens minutes."""
    return rows.filter(F.col(created) > now - F.make_interval(secs=F.lit(hours * 3600.0)))
