"""Lives of items with a time to live, however the stream is cut into batches."""

import datetime

import pytest

from tessera.streaming import expiry

T0 = datetime.datetime(2024, 1, 1)


def events(rows):
    return [(k, T0 + datetime.timedelta(seconds=s)) for k, s in rows]


ROWS = [[("a", 0), ("a", 200), ("b", 10)], [("a", 450), ("c", 500)], [("a", 1200), ("b", 300), ("d", 1300)], [("z", 5000)]]
WANT = {("a", 0, 750, 3), ("a", 1200, 1500, 1), ("b", 10, 600, 2), ("c", 500, 800, 1), ("d", 1300, 1600, 1)}


@pytest.mark.parametrize("batches", [4, 1])
def test_lives_end_by_gap_or_timer(spark, tmp_path, batches):
    parts = ROWS if batches == 4 else [sum(ROWS, [])]
    for n, rows in enumerate(parts):
        spark.createDataFrame(events(rows), "k string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema("k string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ended = expiry.lives(source, "k", "ts", expiry.TOKEN_SECONDS, "1000 seconds")
    ended.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    s = lambda t: int((t - T0).total_seconds())
    found = {(r.k, s(r.opened_at), s(r.expired_at), r.n) for r in spark.read.schema(ended.schema).parquet(f"{tmp_path}/out").collect()}
    assert found == WANT  # z is still open


def test_times_are_rounded_to_milliseconds(spark, tmp_path):
    """As epoch_ms of the query's SQL rounds: 0.9995 s are a second, also as the end of a life and as the watermark."""
    at = lambda **s: T0 + datetime.timedelta(**s)
    seen = [("a", at()), ("a", at(seconds=99, microseconds=999_500)), ("b", at(microseconds=400)), ("z", at(seconds=1399, microseconds=999_600))]
    spark.createDataFrame(seen, "k string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    ended = expiry.lives(spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in"), "k", "ts", expiry.TOKEN_SECONDS, "1000 seconds")
    ended.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    found = {(r.k, r.opened_at, r.expired_at, r.n) for r in spark.read.schema(ended.schema).parquet(f"{tmp_path}/out").collect()}
    assert found == {("a", at(), at(seconds=400), 2), ("b", at(), at(seconds=300), 1)}  # the watermark is at 400 s
