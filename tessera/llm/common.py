"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import importable

#: A word of the size contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder of its own (tests); a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: the lineage ends there, a lost executor costs a reread.

    All that an application writes lies under one folder, which cleaned() removes.
    """
    spark = df.sparkSession
    path = f"{_session_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleaned(spark: SparkSession) -> None:
    """Removes what this application has written. To be called once its results have been used, as they read from there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Where a row of a file lies, in columns of these names.
FILE, ROW = "__file", "__row"
#: Stretches of 64 rows with removed ones are broadcast up to so many (about 200 MB); more of them go file by file.
MAX_BROADCAST_STRETCHES = 1_000_000


def placed(docs: DataFrame) -> DataFrame:
    """docs with the file and the place in it of every row, which tell equal rows apart. What isn't read from files is written first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs, "placed")
    at = docs.metadataColumn("_metadata")
    return docs.select("*", at["file_path"].alias(FILE), at["row_index"].alias(ROW))


def without(docs: DataFrame, removed: DataFrame, most: int = MAX_BROADCAST_STRETCHES) -> DataFrame:
    """placed() docs but for the removed places (FILE, ROW). The documents are read where they lie and never exchanged.

    Removed rows are bits of stretches of 64 rows, which are broadcast. Beyond `most` of these the files are taken in groups,
    each with its own stretches, so no broadcast grows with the data.
    """
    spark, columns = docs.sparkSession, [c for c in docs.columns if c not in (FILE, ROW)]
    bits = F.bit_or(F.expr(f"shiftleft(1L, cast({ROW} % 64 AS int))")).alias("__bits")
    found = written(removed.groupBy(FILE, F.expr(f"{ROW} div 64").alias("__stretch")).agg(bits), "removed")
    files = found.groupBy(FILE).count().orderBy(FILE).collect()  # a row a file, of which the driver keeps a list anyway
    if not files:
        return docs.select(columns)

    def kept(rows: DataFrame, some: DataFrame) -> DataFrame:
        rows = rows.withColumn("__stretch", F.expr(f"{ROW} div 64")).join(F.broadcast(some), [FILE, "__stretch"], "left")
        return rows.filter(F.col("__bits").isNull() | (F.getbit("__bits", F.col(ROW) % 64) == 0)).select(columns)

    if sum(r["count"] for r in files) <= most:
        return kept(docs, found)
    counts, groups, held = {r[FILE]: r["count"] for r in files}, [[]], 0
    for r in docs.select(FILE).distinct().collect():  # a row a file
        if held + counts.get(r[FILE], 0) > most and groups[-1]:
            groups.append([])
            held = 0
        groups[-1].append(r[FILE])
        held += counts.get(r[FILE], 0)
    schema = docs.select(columns).schema
    parts = [kept(placed(spark.read.schema(schema).parquet(*g)), found.filter(F.col(FILE).isin(g))) for g in groups]
    return reduce(DataFrame.unionAll, parts)


def small(rows: DataFrame, most: int) -> DataFrame:
    """Rows that are cheap to count (written ones), to be broadcast if there are at most so many."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def few_rows(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A few rows of the driver as a table, by Arrow: a list would pass plain Python workers, which stay beside those of the UDFs."""
    columns = zip(*rows) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema))


@contextmanager
def given_back() -> Iterator[None]:
    """Around a task's Python work: at its end the worker gives back what it has freed, as it stays beside the JVM in later stages."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
