"""Role tables over the driver's tables: what an asset, a message or a participant is there."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, unless it was shipped to them."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, _ROOT]))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def written(rows: DataFrame, what: str) -> DataFrame:
    """Rows written to the shared folder and read again: the lineage ends there, and a lost executor costs a reread."""
    path = scratch(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Written rows of a few columns are broadcast up to so many.
MAX_BROADCAST_ROWS = 500_000


def small(rows: DataFrame) -> DataFrame:
    """Rows that are cheap to count (written ones), to be broadcast where they are few."""
    return F.broadcast(rows) if rows.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else rows


#: Up to this size an input is dealt out over the cores; a larger one has row groups enough for all of them.
SPREAD_BYTES = 256 * 1024 * 1024


def spread(rows: DataFrame) -> DataFrame:
    """A small input, often one row group that a single task would read, over all cores; a larger one as it is."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else rows


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assets: asset_id, ts, media_type, scope_id (the user)."""
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("asset_id"), "ts", F.col("event_type").alias("media_type"), F.col("user_id").alias("scope_id"), "value", "props")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and region as places; those with a negative balance have none."""
    nation = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = load(spark, sf_dir, "customer").withColumn("k", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")))
    return customers.join(F.broadcast(nation), F.col("k") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("asset_id"), F.col("n_name").alias("city"), F.col("r_name").alias("place"))  # 25 nations


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that take part in an order."""
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
