"""Scans, lookups and counters over role tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(rows: DataFrame, by: str, key: str, n: int, where: Column | None = None) -> DataFrame:
    """The newest n rows, ties by key: a top-k that never sorts all rows."""
    kept = rows if where is None else rows.filter(where)
    return kept.orderBy(F.desc_nulls_last(by), F.asc(key)).limit(n)


def earliest_by_hash(assets: DataFrame, content: str, created: str, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per content hash (and further keys) the earliest asset, and how many share the content."""
    hashed = assets.withColumn("content_sha256", F.sha2(F.col(content), 256))
    return hashed.groupBy("content_sha256", *by).agg(F.min(F.struct(created, key))[key].alias(key), F.count(F.lit(1)).alias("copies"))


def near_duplicate_groups(assets: DataFrame, content: str, key: str) -> DataFrame:
    """Every asset with its group of equal content: leader (smallest key) and size. Nothing is dropped."""
    hashed = assets.select(key, F.sha2(F.col(content), 256).alias("content_sha256"))
    groups = hashed.groupBy("content_sha256").agg(F.min(key).alias("leader"), F.count(F.lit(1)).alias("group_size"))
    return hashed.join(groups, "content_sha256").select(key, "leader", "group_size", (F.col(key) == F.col("leader")).alias("is_leader"))


def counters(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n of each table: one union of aggregates."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


ALLOWED_TABLES = frozenset({"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"})


def table_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    if name not in ALLOWED_TABLES:
        raise ValueError(f"not a countable table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").count()


def paged(rows: DataFrame, order: list[Column], page: int, size: int, most: int = 100) -> DataFrame:
    """A page of the rows with stable ordinals from 1; page and size are clamped.

    Only the rows up to the page's end are ranked: a top-k first, then numbers.
    """
    page, size = max(1, page), min(max(1, size), most)
    top = rows.orderBy(*order).limit(page * size)
    return top.withColumn("ordinal", F.row_number().over(W.orderBy(*order))).filter(F.col("ordinal") > (page - 1) * size)


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value and n of each column's distinct values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("f")).select("f.facet", "f.value").filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def decoded(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with JSON columns decoded by their schemas; what doesn't parse is null."""
    return rows.withColumns({c: F.from_json(c, schema) for c, schema in columns.items()})


def looked_up(wanted: DataFrame, tables: dict[str, tuple[DataFrame, str]], kind: str, key: str) -> DataFrame:
    """wanted (kind, key) with found: whether the table of its kind has the id. One join for all kinds, no lookup by row."""
    ids = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("__k"), F.col(id_).cast("string").alias("__id")) for name, (df, id_) in tables.items()]).distinct()
    rows = wanted.join(ids, (F.col(kind) == F.col("__k")) & (F.col(key).cast("string") == F.col("__id")), "left")
    return rows.withColumn("found", F.col("__id").isNotNull()).drop("__k", "__id")


def dashboard(tables: dict[str, DataFrame], lists: dict[str, tuple[DataFrame, str, str]], newest_n: int = 8) -> DataFrame:
    """name, position and value: counts of tables (position 0), and the newest ids of lists (rows, by, key) from position 1 on."""
    parts = [df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("name"), F.lit(0).alias("position"), "value") for name, df in tables.items()]
    for name, (df, by, key) in lists.items():
        top = newest(df, by, key, newest_n).withColumn("position", F.row_number().over(W.orderBy(F.desc_nulls_last(by), F.asc(key))))
        parts.append(top.select(F.lit(name).alias("name"), "position", F.col(key).cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def faceted(rows: DataFrame, facets: dict[str, tuple], text: str, needle: str | None) -> DataFrame:
    """rows whose facets have one of the chosen values each (none chosen: any) and whose text contains the needle."""
    for column, chosen in facets.items():
        if chosen:
            rows = rows.filter(F.col(column).isin(*chosen))
    return rows.filter(F.contains(F.lower(text), F.lit(needle.lower()))) if needle else rows
