"""Manifests of stored tables: written last, numbered, the newest one holds.

What a manifest names is whole: a writer that was lost before has left folders that nobody reads.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_SCHEMA = "number long, manifest string"


def newest(spark: SparkSession, path: str) -> dict | None:
    """The manifest that was published last under a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    row = spark.read.schema(_SCHEMA).json(f"{path}/manifest").orderBy(F.desc("number"), "manifest").first()
    return json.loads(row["manifest"]) if row else None


def publish(spark: SparkSession, path: str, manifest: dict) -> dict:
    """Makes a manifest (with its number) the newest one."""
    spark.createDataFrame([(manifest["number"], json.dumps(manifest))], _SCHEMA).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return manifest
