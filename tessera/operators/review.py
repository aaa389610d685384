"""Reviews: taxonomies, entity cards, cluster diagnostics and identities, verification of claims, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def taxonomy(value: Column, choices: list[str], aliases: dict[str, str], hints: list[tuple[str, str]], other: str = "OTHER") -> Column:
    """A label in a closed vocabulary: a choice itself, else an alias, else the first hint that it contains, else other."""
    label = F.lower(F.trim(value))
    out = F.when(label.isin(*[c.lower() for c in choices]), F.upper(label))
    for alias, choice in aliases.items():
        out = out.when(label == alias.lower(), choice)
    for hint, choice in hints:
        out = out.when(F.contains(label, F.lit(hint.lower())), choice)
    return out.otherwise(other)


def classified(named: list[Column], details: Column, text: Column, choices: list[str], aliases: dict[str, str], hints: list[tuple[str, str]], allowed: list[str], detail_hints: list[tuple[str, str]] = (), other: str = "OTHER") -> Column:
    """struct<primary, details, raw> of a label that was named in several ways, the most reliable first.

    primary: the first way that is a choice or an alias of one; where none is, the first that holds a hint; else other.
    details: those of the array that are allowed, each once, in order; where none were given, those whose hint the text holds.
    raw: what was said and isn't kept: the first named way, if the primary is another word, then details that aren't allowed.
    """
    trimmed = [F.trim(F.coalesce(c, F.lit(""))) for c in named]
    certain = [taxonomy(c, [x for x in choices if x != other], aliases, [], other) for c in trimmed]
    hinted = [taxonomy(c, [x for x in choices if x != other], aliases, hints, other) for c in trimmed]
    primary = F.coalesce(*[F.when(c != other, c) for c in (*certain, *hinted)], F.lit(other))
    none = F.array().cast("array<string>")
    given = F.array_distinct(F.filter(F.transform(F.coalesce(details, none), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    known = F.array(*[F.lit(a) for a in allowed]).cast("array<string>")
    held = F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(h.lower())), F.lit(d)) for h, d in detail_hints]).cast("array<string>"))
    kept = F.when(F.size(given) == 0, F.array_distinct(F.coalesce(held, none))).otherwise(F.array_intersect(given, known))
    said = F.get(F.filter(F.array(*trimmed), lambda x: x != ""), F.lit(0))
    lost = F.when(said.isNotNull() & (F.lower(said) != F.lower(primary)), F.array(said)).otherwise(none)
    return F.struct(primary.alias("primary"), kept.alias("details"), F.concat(lost, F.array_except(given, known)).alias("raw"))


def observation_graph(observations: DataFrame, key: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Entities (kind, name, mentions) and edges (observation, kind, name) from the named array columns."""
    each = F.explode(F.flatten(F.array(*[F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("name"))) for kind, c in fields.items()])))
    edges = observations.select(key, each.alias("e")).select(key, "e.kind", "e.name").filter("name <> ''").distinct()
    return edges.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("mentions")), edges


def entity_cards(entities: DataFrame, mentions: DataFrame, relations: DataFrame, key: str, ts: str) -> DataFrame:
    """Per entity the number of mentions and relations and the latest mention: two aggregates joined once, no lookups."""
    m = mentions.groupBy(key).agg(F.count(F.lit(1)).alias("mentions"), F.max(ts).alias("latest"))
    r = relations.select(F.explode(F.array("a", "b")).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("relations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entities.select(key).join(m, key, "left").join(r, key, "left").select(key, zero("mentions"), zero("relations"), "latest")


def retained_ids(new: DataFrame, old: DataFrame, member: str, cluster: str) -> DataFrame:
    """New clusters with the old id they keep: the old cluster they share most members with, each old id given once.

    new, old: member and cluster. A new cluster whose best old one went to a larger overlap is new.
    """
    o = old.select(member, F.col(cluster).alias("old_cluster"))
    shared = new.join(o, member).groupBy(cluster, "old_cluster").agg(F.count(F.lit(1)).alias("n"))
    best_old = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("n"), "old_cluster"))
    best_new = F.row_number().over(W.partitionBy("old_cluster").orderBy(F.desc("n"), cluster))
    kept = shared.withColumn("x", best_old).withColumn("y", best_new).filter("x = 1 AND y = 1").select(cluster, "old_cluster")
    return new.select(cluster).distinct().join(kept, cluster, "left")


def cluster_diagnostics(rows: DataFrame, cluster: str, vector: str, asset: str) -> DataFrame:
    """Per cluster: size, mean similarity within (of unit vectors, from their sum), and assets that occur more than once."""
    each = rows.select(cluster, F.posexplode(vector).alias("d", "x")).groupBy(cluster, "d").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sums = each.groupBy(cluster).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    n = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(asset).alias("assets"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") <= 3, "2-3").when(F.col("n") <= 10, "4-10").otherwise("11+")
    within = F.when(F.col("n") > 1, (F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1)))
    return n.join(sums, cluster).select(cluster, "n", bucket.alias("size_bucket"), within.alias("within"), (F.col("n") - F.col("assets")).alias("conflicts"))


def size_histogram(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("size_bucket").agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("members"))


def primary(rows: DataFrame, image: str, order: list[str], label: str) -> DataFrame:
    """The label of each image's foremost face: the highest by order."""
    return rows.groupBy(image).agg(F.max(F.struct(*order, label))[label].alias(label))


def verified(claims: DataFrame, evidence: DataFrame, scope: Column, viewer: Column) -> DataFrame:
    """claims with support: `supported` if any candidate evidence may be seen, `hidden` if only others' is there, else `unsupported`.

    claims: claim_id, candidates (array of ids). evidence: evidence_id, and what scope and viewer look at.
    """
    seen = evidence.select("evidence_id", (scope & viewer).alias("visible"))
    found = claims.select("claim_id", F.explode_outer("candidates").alias("evidence_id")).join(seen, "evidence_id", "left")
    tally = found.groupBy("claim_id").agg(F.max(F.coalesce("visible", F.lit(False))).alias("any_visible"), F.count("visible").alias("known"))
    return tally.select("claim_id", F.when(F.col("any_visible"), "supported").when(F.col("known") > 0, "hidden").otherwise("unsupported").alias("support"))


def ledger_problems(runs: DataFrame, roles: list[str], model: str) -> DataFrame:
    """Per run: required roles that were never called, calls to another model, and degraded calls. runs: run_id, role, model, degraded."""
    tally = runs.groupBy("run_id").agg(F.collect_set("role").alias("r"), F.count_if(F.col("model") != model).alias("other_model"), F.count_if("degraded").alias("degraded"))
    missing = F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(r) for r in roles]), "r")), ",")
    return tally.select("run_id", missing.alias("missing_roles"), "other_model", "degraded")


def consistent_judgement(verdict: Column, reason: Column, contradictions: str) -> Column:
    """Whether a positive verdict isn't taken back by its own reason."""
    return ~(F.lower(verdict).isin("pass", "correct", "yes") & F.coalesce(reason, F.lit("")).rlike(contradictions))


def acceptance(rows: DataFrame, parsed: str, slots: list[str]) -> DataFrame:
    """Share of parsed rows, and of rows with the right value of each slot (columns slot and expected_slot)."""
    right = [F.avg(F.col(s).eqNullSafe(F.col(f"expected_{s}")).cast("double")).alias(s) for s in slots]
    return rows.agg(F.avg(F.col(parsed).cast("double")).alias("accepted"), *right)


def evidence_paths(paths: dict[str, DataFrame], entity: str, evidence: str) -> DataFrame:
    """Per entity the evidence over each path, and distinct evidence over all of them."""
    rows = None
    for name, df in paths.items():
        part = df.select(F.col(entity).alias("entity"), F.col(evidence).alias("evidence"), F.lit(name).alias("path"))
        rows = part if rows is None else rows.unionByName(part)
    each = [F.countDistinct(F.when(F.col("path") == name, F.col("evidence"))).alias(name) for name in paths]
    return rows.groupBy("entity").agg(*each, F.countDistinct("evidence").alias("evidence"))


def cards_with_clusters(entities: DataFrame, clusters: DataFrame, faces: DataFrame, key: str) -> DataFrame:
    """Per entity its clusters, faces and best face. clusters: cluster_id and the entity's key. faces: cluster_id, face_id, quality.

    Left joins of two aggregates, so entities without a cluster stay.
    """
    members = faces.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("quality", "face_id")).alias("best"))
    held = clusters.join(members, "cluster_id", "left").groupBy(key).agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("faces"), F.max("best")["face_id"].alias("avatar"))
    rows = entities.select(key).join(held, key, "left")
    return rows.select(key, F.coalesce("clusters", F.lit(0)).alias("clusters"), F.coalesce("faces", F.lit(0)).alias("faces"), "avatar")
