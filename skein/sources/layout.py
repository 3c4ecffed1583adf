"""Range- and list-partitioned layouts: writing with bounds checks, pruned reading, reconciling, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "__default__"


def by_list(column: str, known: list[str], default: bool = True) -> Column:
    """A list partition's name: the value itself if known, else the default partition (or null without one)."""
    other = F.lit(DEFAULT) if default else F.lit(None).cast("string")
    return F.when(F.col(column).isin(known), F.col(column)).otherwise(other)


def unmatched(frame: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """Rows outside the half-open range that the partitions cover; null keys are outside."""
    inside = F.col(column).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")) & (F.col(column) < F.lit(high).cast("timestamp_ntz"))
    return frame.where(~F.coalesce(inside, F.lit(False)))


def write_partitioned(frame: DataFrame, path: str, part: Column, name: str, mode: str = "error") -> None:
    """One folder per value; rows are dealt by value and a salt, so that a large value has several writers and files."""
    salt = F.pmod(F.xxhash64(*frame.columns), F.lit(8))
    rows = frame.withColumn(name, part)
    rows.repartition(F.col(name), salt).write.mode(mode).partitionBy(name).parquet(path)


def by_month(column: str) -> Column:
    """A range partition's name: the month, as yyyy-MM."""
    return F.date_format(column, "yyyy-MM")


def between(column: str, name: str, low: str, high: str) -> Column:
    """The half-open range low <= column < high over a layout by month: months outside it aren't read."""
    start, stop = F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")
    months = (F.col(name) >= low[:7]) & (F.col(name) <= high[:7]) if high[7:] not in ("", "-01") else (F.col(name) >= low[:7]) & (F.col(name) < high[:7])
    return months & (F.col(column) >= start) & (F.col(column) < stop)


def detach_partition(spark: SparkSession, path: str, name: str, value: str, to: str) -> bool:
    """Move a partition's folder out of the layout: its rows are a table of their own at `to`, and none is read. False if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/{name}={value}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(folder) and fs.rename(folder, hadoop.Path(to)))


def truncate(spark: SparkSession, path: str) -> None:
    """Remove all rows of a layout; its schema stays in one empty file."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)


def partitions(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition folders below a path."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName())


def reconcile(spark: SparkSession, path: str, name: str, expected: list[str]) -> dict[str, list[str]]:
    """Partitions that are expected but missing, and present but not expected."""
    present = {p.split("=", 1)[1] for p in partitions(spark, path)}
    return {"missing": sorted(set(expected) - present), "unexpected": sorted(present - set(expected))}


def drop_partition(spark: SparkSession, path: str, name: str, value: str) -> bool:
    """Retention by dropping a whole partition: no row is read. False if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}={value}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(folder, True))
