"""Streams over growing folders of Parquet files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from skein.operators import folds


def read_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of a folder's or file's rows; `files_per_batch` bounds a micro-batch (back-pressure)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(file).isFile():
        # Streams watch folders: the file's folder, for files of its name.
        reader, path = reader.option("pathGlobFilter", file.getName()), file.getParent().toString()
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_event_time(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def inbox(messages: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Each message id once. Ids are forgotten after the watermark; a ledger table is needed for longer memory."""
    return messages.dropDuplicatesWithinWatermark([id_col])


def counts_per_window(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"))


def drain(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append", empty_batches: bool = True) -> list[dict]:
    """Deliver all that is there, batch by batch; the checkpoint remembers what was delivered. Gives the progress of each batch.

    A batch may be delivered again after a failure, so the sink must know batches by their number. A stream with timeouts
    of processing time asks for empty batches without end; it is drained without them.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(empty_batches).lower())
    try:
        query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()
    return [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """Effectively once: a batch overwrites the folder of its own number, so a second delivery changes nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def at_least_once(path: str) -> Callable[[DataFrame, int], None]:
    """Every delivery is appended: a batch delivered again stands twice."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(path)

    return sink


def at_most_once(path: str) -> Callable[[DataFrame, int], None]:
    """A batch is marked before it is written: one whose writing failed is never written."""

    def sink(batch: DataFrame, number: int) -> None:
        hadoop = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
        mark = hadoop.Path(f"{path}/_begun-{number}")
        fs = mark.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration())
        if fs.createNewFile(mark):
            batch.write.parquet(f"{path}/batch={number}")

    return sink


def publish_to(path: str, topic: str) -> Callable[[DataFrame, int], None]:
    """A broker of folders: each batch's messages below the topic named by a column, known by the batch's number."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("topic", F.col(topic)).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic", "batch").parquet(path)

    return sink


class PollMetrics(StreamingQueryListener):
    """Counts polls, rows and milliseconds of each stream, by its name or id."""

    def __init__(self):
        self.polls: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        own = self.polls.setdefault(event.progress.name or str(event.progress.id), {"polls": 0, "rows": 0, "ms": 0})
        own["polls"] += 1
        own["rows"] += event.progress.numInputRows
        own["ms"] += event.progress.batchDuration

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def limited(requests: DataFrame, key: str, capacity: float, per_second: float, idle_ms: int) -> DataFrame:
    """Adds allowed and tokens to a stream of requests with a time `at` in microseconds: a token bucket per key as keyed state.

    A micro-batch's rows of a key are taken in the order of (at, event_id). A bucket idle for `idle_ms` of processing time
    is forgotten, which is harmless once it would be full again.
    """
    names = requests.columns
    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("tokens", T.DoubleType())])
    step = folds.token_bucket(capacity, per_second)

    def run(own, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(frames), ignore_index=True).sort_values(["at", "event_id"], kind="stable", ignore_index=True)
        now, out = (state.get if state.exists else None), []
        for at in batch["at"].tolist():
            now, row = step(now, (at,))
            out.append(row)
        state.update((float(now[0]), int(now[1])))
        state.setTimeoutDuration(idle_ms)
        batch["allowed"], batch["tokens"] = [bool(r[0]) for r in out], [float(r[1]) for r in out]
        yield batch[[*names, "allowed", "tokens"]]

    return requests.groupBy(key).applyInPandasWithState(run, schema, "tokens double, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)
