"""Sharding (operator 2): contiguous shards of equal bytes, cut from global prefix sums.

Rows are put in the order of (hash of the text, doc_id) by a range exchange, so equal texts lie side by side and no key,
however common, fills one partition; every partition is sorted and written. Sums of each partition give every partition its
first byte; a running sum over the narrow rows of a partition gives every row its own. A row goes to the shard in which its
middle byte lies, so a shard is one stretch of rows of each partition: these stretches are a small table, by which the written
rows get shard and slot without moving again.

Law: `bytes`. A shard's bytes differ from total / shards by one document's size at most. A run of equal texts is cut only
where a shard ends.

Edge cases: a null text has no bytes (size 1, CRC-32 0); null and repeated doc_ids are rows like any other; rows that tie in
the order are equal in text and doc_id, and keep the order in which they were written; a text of any length is one row; an
empty table gives no rows; a document larger than a shard's share leaves a neighbouring shard empty; further columns are kept
by sharded_documents, but `shard` and `slot`, which it replaces, and names that begin with two underscores, which are its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import table, written

N_SHARDS = 16
#: Stretches are broadcast up to so many rows (about 60 bytes each; one for a partition and a shard at most).
MAX_BROADCAST_ROWS = 500_000


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("__size", (F.octet_length(text) + 1).cast("long")).withColumn("__crc", F.crc32(text.cast("binary"))).withColumn("__hash", F.xxhash64(text))


_ORDER = ("__hash", "__size", "__crc", "doc_id")


def ordered(rows: DataFrame) -> DataFrame:
    """rows (with _ORDER's columns) in the whole order, written, with __part and __at: partition and place in it, from 0."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *_ORDER).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*_ORDER)
    # Numbered in the order of the partition: the low 33 bits of this id count a partition's rows.
    return written(rows.withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "shards")


def stretches(rows: DataFrame, n_shards: int) -> DataFrame:
    """__part, shard, __from, __to and __slot: the rows of each partition that lie in a shard, and the first one's slot."""
    narrow = rows.select("__part", "__at", "__size")
    sums = narrow.groupBy("__part").agg(F.sum("__size").alias("b"))  # a row a partition: a few thousand at most
    before = F.coalesce(F.sum("b").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__part", before.alias("__b0"), F.sum("b").over(W.partitionBy()).alias("__total"))
    end = F.sum("__size").over(W.partitionBy("__part").orderBy("__at"))
    placed = narrow.withColumn("__end", end).join(F.broadcast(sums), "__part").withColumn("__end", F.col("__end") + F.col("__b0"))
    middle = F.col("__end") * 2 - F.col("__size")
    shard = F.floor(middle.cast("decimal(38,0)") * n_shards / (F.col("__total") * 2)).cast("int")
    found = placed.groupBy("__part", shard.alias("shard")).agg(F.min("__at").alias("__from"), F.max("__at").alias("__to"))
    slot = F.sum(F.col("__to") - F.col("__from") + 1).over(W.partitionBy("shard").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("__slot", F.coalesce(slot, F.lit(0)))


def _cut(rows: DataFrame, n_shards: int) -> DataFrame:
    """Adds shard and slot to ordered rows."""
    found = written(stretches(rows, n_shards), "stretches")
    found = F.broadcast(found) if found.count() <= MAX_BROADCAST_ROWS else found
    out = rows.join(found, "__part").filter(F.col("__at").between(F.col("__from"), F.col("__to")))
    return out.withColumn("slot", F.col("__at") - F.col("__from") + F.col("__slot"))


def shard_rows(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row. Texts are read once and not moved."""
    rows = _measured(docs.select("doc_id", "text")).drop("text")
    out = _cut(ordered(rows), n_shards)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def sharded_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """docs' columns with shard and slot (in place of columns of these names). Texts move once, by the range exchange."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    return _cut(ordered(_measured(docs.select(kept))), n_shards).select(*kept, "shard", F.col("slot").cast("long"))


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all documents: 16 shards of near equal bytes."""
    return shard_rows(table(spark, sf_dir, "documents"), N_SHARDS)
