"""Streams drained into files, whose rows must equal the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators.ordered import TOKEN_BUCKET
from skein.operators.registry import query
from skein.shared import new_dir
from skein.sources.tables import micros
from skein.streaming import streams


def _drained(spark, stream, name: str, empty_batches: bool = True):
    folder = new_dir(spark, name)
    streams.drain(stream, f"{folder}/checkpoint", streams.append_to(f"{folder}/out"), empty_batches=empty_batches)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch=*")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_inbox(spark, sf):
    """Every event delivered twice, kept once."""
    events = streams.read_table(spark, f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    twice = events.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    return _drained(spark, streams.inbox(streams.with_event_time(twice, "40 days")).select("event_id", "user_id", "event_type"), "inbox")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'click'")
def stream_outbox(spark, sf):
    events = streams.read_table(spark, f"{sf}/events.parquet")
    return _drained(spark, events.where("event_type <> 'click'").select("event_id", "event_type"), "outbox")


@query(TOKEN_BUCKET)
def stream_limiter(spark, sf):
    """The token bucket as keyed state of a stream."""
    events = streams.read_table(spark, f"{sf}/events.parquet").select("event_id", "user_id", micros("ts").alias("at"))
    return _drained(spark, streams.limited(events, "user_id", 3, 1 / 14400, 86_400_000), "limiter", empty_batches=False).select("event_id", "user_id", "allowed", F.round("tokens", 6).alias("tokens"))


@query("SELECT event_type AS topic, count(*) AS n FROM events GROUP BY event_type")
def stream_broker(spark, sf):
    """Events published to the topic of their type."""
    folder = new_dir(spark, "broker")
    events = streams.read_table(spark, f"{sf}/events.parquet").select("event_id", "event_type")
    streams.drain(events, f"{folder}/checkpoint", streams.publish_to(f"{folder}/out", "event_type"))
    return spark.read.parquet(f"{folder}/out").groupBy("topic").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, true AS polled FROM events")
def stream_poll_metrics(spark, sf):
    """Rows that the polls of a drained stream report."""
    folder = new_dir(spark, "polled")
    progress = streams.drain(streams.read_table(spark, f"{sf}/events.parquet"), f"{folder}/checkpoint", streams.append_to(f"{folder}/out"))
    return spark.createDataFrame([(sum(p["numInputRows"] for p in progress), len(progress) > 0)], "n_rows long, polled boolean")


@query("SELECT time_bucket(interval 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Hourly counts of a stream; each batch replaces the counts so far."""
    folder = new_dir(spark, "windows")
    counts = streams.counts_per_window(streams.with_event_time(streams.read_table(spark, f"{sf}/events.parquet")))
    streams.drain(counts, f"{folder}/checkpoint", lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out"), "complete")
    per = spark.read.schema(counts.schema).parquet(f"{folder}/out")
    return per.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
