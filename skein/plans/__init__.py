"""Inspection of physical plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def formatted(frame: DataFrame) -> str:
    """The plan as explain("formatted") prints it."""
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def pushed_filters(frame: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\]", formatted(frame))


def partition_filters(frame: DataFrame) -> list[str]:
    return re.findall(r"PartitionFilters: \[(.*?)\]", formatted(frame))


def read_columns(frame: DataFrame) -> list[list[str]]:
    """Columns that each scan reads."""
    return [re.findall(r"(\w+):", s) for s in re.findall(r"ReadSchema: struct<(.*?)>\n", formatted(frame))]


def count_nodes(frame: DataFrame, name: str) -> int:
    """How often a node stands in the plan."""
    return len(re.findall(rf"^\(\d+\) {name}\b", formatted(frame), re.M))
