"""Rows removed by their places: whole results however they are grouped, and no exchange of what stays."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, simhash
from tessera.llm.common import FILE, ROW, placed, table, without, written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_removed_places_and_no_others(spark, most):
    docs = placed(written(spark.range(1000).select("id", F.col("id").cast("string").alias("text")).repartition(5), "docs"))
    gone = docs.filter("id % 7 = 0")
    left = without(docs, gone.select(FILE, ROW), most)
    assert left.columns == ["id", "text"]
    assert sorted(r.id for r in left.collect()) == [i for i in range(1000) if i % 7]


def test_nothing_and_everything_removed(spark):
    docs = placed(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "id long, text string"))
    assert without(docs, docs.select(FILE, ROW).limit(0)).count() == 3
    assert without(docs, docs.select(FILE, ROW)).count() == 0


def test_equal_rows_are_told_apart(spark):
    docs = placed(spark.createDataFrame([(1, "a")] * 100, "id long, text string"))
    some = written(docs.select(FILE, ROW).orderBy(FILE, ROW).limit(30), "some")
    assert without(docs, some).count() == 70


def exchanged(df):
    """The columns of all exchanges of a plan that has run."""
    df.write.format("noop").mode("overwrite").save()
    return [line for line in df._jdf.queryExecution().toString().splitlines() if "Exchange" in line and "Broadcast" not in line]


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_stages_do_not_exchange_documents(spark, monkeypatch, most):
    """Whatever is removed: the plan of what stays has no exchange at all."""
    monkeypatch.setattr(common.without, "__defaults__", (most,))
    docs = written(table(spark, SF, "documents").repartition(4), "docs")
    for left in (simhash.one_of_each(docs), decontaminate.remove_documents(docs, table(spark, SF, "benchmark"))):
        assert 0 < left.count() < docs.count()
        assert exchanged(left) == []


def test_one_of_each_without_ids_and_with_shared_ids(spark):
    rows = [(None, "one two three four"), (None, "one two three four"), (5, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "six seven eight nine ten"), (4, "alpha beta gamma delta"), (None, None), (9, "")]
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, [(None, "one two three four"), (5, "six seven eight nine ten"), (4, "alpha beta gamma delta"), (9, "")]))
