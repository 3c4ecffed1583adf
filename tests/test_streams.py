"""Streams: redelivery under each delivery contract, back-pressure, metrics of polls, state that expires."""

import pytest
from pyspark.sql import functions as F

from skein.operators import catalog
from skein.sources.tables import load, micros
from skein.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(spark, tmp_path):
    """Events in four files, oldest first."""
    events = load(spark, SF, "events").withColumn("part", F.floor(F.col("event_id") / 250))
    for k in range(4):
        events.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path


def redelivered(spark, folder, sink, files=1):
    """Drain; the second batch fails once after it was written (or before), and the stream starts again."""
    stream = streams.read_table(spark, str(folder / "in"), files_per_batch=files).select("event_id", "event_type")
    failed = []

    def flaky(batch, number):
        sink(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after writing")

    with pytest.raises(Exception):
        streams.drain(stream, str(folder / "checkpoint"), flaky)
    streams.drain(stream, str(folder / "checkpoint"), flaky)
    assert failed == [1]
    return spark.read.schema("event_id long, event_type string, batch long").parquet(str(folder / "out"))


def test_effectively_once(spark, folder):
    got = redelivered(spark, folder, streams.append_to(str(folder / "out")))
    assert got.count() == got.select("event_id").distinct().count() == 1000


def test_at_least_once(spark, folder):
    got = redelivered(spark, folder, streams.at_least_once(str(folder / "out")))
    assert got.select("event_id").distinct().count() == 1000 < got.count()


def test_at_most_once(spark, folder):
    sink = streams.at_most_once(str(folder / "out"))
    written = []

    def lossy(batch, number):
        # The first attempt at the second batch dies between its mark and its rows.
        if number == 1 and not written:
            written.append(number)
            sink(batch.limit(0), number)
            raise RuntimeError("lost before writing")
        sink(batch, number)

    stream = streams.read_table(spark, str(folder / "in"), files_per_batch=1).select("event_id")
    with pytest.raises(Exception):
        streams.drain(stream, str(folder / "checkpoint"), lossy)
    streams.drain(stream, str(folder / "checkpoint"), lossy)
    got = spark.read.schema("event_id long").parquet(str(folder / "out") + "/batch=*")
    assert got.count() == got.distinct().count() == 750


def test_a_published_batch_is_published_once(spark, folder):
    redelivered(spark, folder, streams.publish_to(str(folder / "out"), "event_type"))
    got = spark.read.parquet(str(folder / "out"))
    assert got.count() == 1000 and got.where("topic <> event_type").count() == 0


def test_micro_batches_are_bounded_and_counted(spark, folder):
    metrics = streams.PollMetrics()
    spark.streams.addListener(metrics)
    try:
        progress = streams.drain(streams.read_table(spark, str(folder / "in"), files_per_batch=1), str(folder / "checkpoint"), streams.append_to(str(folder / "out")))
        rows = [p["numInputRows"] for p in progress if p["numInputRows"]]
        assert len(rows) == 4 and max(rows) <= 250
        import time

        for _ in range(50):
            if sum(m["rows"] for m in metrics.polls.values()) == 1000:
                break
            time.sleep(0.1)
        assert sum(m["rows"] for m in metrics.polls.values()) == 1000
    finally:
        spark.streams.removeListener(metrics)


def test_limiter_over_several_batches_equals_the_batch_query(spark, folder):
    stream = streams.read_table(spark, str(folder / "in"), files_per_batch=1).select("event_id", "user_id", micros("ts").alias("at"))
    limited = streams.limited(stream, "user_id", 3, 1 / 14400, 86_400_000)
    streams.drain(limited, str(folder / "checkpoint"), streams.append_to(str(folder / "out")), empty_batches=False)
    got = {r["event_id"]: (r["allowed"], round(r["tokens"], 6)) for r in spark.read.schema(limited.schema).parquet(str(folder / "out") + "/batch=*").collect()}
    assert got == {r["event_id"]: (r["allowed"], r["tokens"]) for r in catalog.queries()["token_bucket"](spark, SF).collect()}
