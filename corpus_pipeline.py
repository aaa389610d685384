"""Corpus pipeline: documents in, shards of a clean, mixed corpus out, one stage after another.

A stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept.

Edge cases: what each operator says of nulls, empty and very long texts, ties and repeats holds for its stage. A document
without a letter goes in the first stage, and so with it every null and empty text; of equal rows one stays; a document that
holds only whole benchmark items of 1 to 7 words stays (such phrases stand in clean documents by chance: see
MIN_REMOVED_WORDS of the operator); null doc_ids and sources are values like any other; further columns stay as they are, but
`shard` and `slot`, which the last stage adds, and names that begin with two underscores; an empty table gives no rows. A
document comes as often as the mix takes it, in part where its source's walk begins or ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.catalog import importable
from tessera.llm.common import table, written
from tessera.llm.decontaminate import remove_documents
from tessera.llm.langid import identified
from tessera.llm.mixing import mixed_documents
from tessera.llm.sharding import sharded_documents
from tessera.llm.simhash import one_of_each


#: Rows that go to a Python worker at once: a batch of texts is held by the JVM beside its heap, and by the worker twice.
BATCH_ROWS = 2000


def _for_python(spark: SparkSession) -> None:
    """For the session, as stages are run after they are made.

    The workers' path is set before the first of them starts: were it set later, each executor would start a second Python daemon and
    keep the first.
    """
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents whose language can't be told go: those without letters, or unlike all learned languages."""
    _for_python(spark)
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near-duplicates the document with the smallest doc_id stays."""
    _for_python(spark)
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold ten consecutive words of a benchmark item go, or all words of a shorter one of 8 or 9."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sources weigh 1, 2, 3, repeating; a document comes as often, and as much of it, as the mix takes."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: 16 contiguous shards of near equal bytes; adds shard and slot."""
    return sharded_documents(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: No SQL for learned language labels and 64-bit XXH64 fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
