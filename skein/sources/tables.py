"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: str | Column) -> Column:
    """A two-decimal amount as whole cents: sums of them don't depend on order."""
    column = F.col(amount) if isinstance(amount, str) else amount
    return F.round(column * 100).cast("long")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))
