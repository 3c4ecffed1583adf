"""Stored tables, copies of rows and what Python workers keep, used by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.shared import new_dir, remove, settle, shared_dir  # noqa: F401  the corpus operators take them from here


def store(frame: DataFrame, kind: str, path: str | None = None) -> DataFrame:
    """Write the frame as Parquet below the shared folder (or at `path`) and read it back."""
    spark = frame.sparkSession
    path = path or new_dir(spark, kind)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def filesystem(uri: str) -> tuple[Any, str]:
    """The file system of a shared path and the path within it, for tasks that read or write files themselves."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def each_copy(rows: DataFrame, n: str, out: str, part: int = 10_000) -> DataFrame:
    """Every row `n` times, numbered from 0 in `out`. A row that stands for very many is cut into parts of equal
    numbers, which are dealt over all tasks before they become rows.
    """
    one = rows.where(F.col(n) <= part).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    cut = rows.where(F.col(n) > part).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / part))))
    cut = cut.repartition(*[F.col(c) for c in cut.columns])
    last = F.least(F.col(n), (F.col("_part") + 1) * part) - 1
    many = cut.withColumn(out, F.explode(F.sequence(F.col("_part") * part, last))).drop("_part")
    return one.where(F.col(n) > 0).unionByName(many)


def kept_in_worker(name: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker process, kept over its tasks. Only what any task may rebuild."""
    store = sys.modules.setdefault("skein_kept_in_worker", types.ModuleType("skein_kept_in_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def give_back() -> None:
    """Return freed memory of this process to the system; workers live on, and many small pieces keep it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)
