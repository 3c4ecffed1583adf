"""Log sources: one JSON object per line, and free text of several formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a request log line; more may stand in it.
REQUEST = "requestId string, route string, method string, statusCode int, durationMs double, outcome string, ts string, _corrupt_record string"


def read_ndjson(spark: SparkSession, path: str, schema: str = REQUEST) -> DataFrame:
    """One row per line; a line that is no JSON keeps its text in _corrupt_record."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def field_in_text(line: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that a line matches; null if it matches none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns])
