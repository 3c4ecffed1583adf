"""Running sums over a whole table's order without one task for it: range-sorted parts, sums per part, then within parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm._work import settle


def numbered(rows: DataFrame, keys: list[str], amount: str = "n", out: str = "rank") -> DataFrame:
    """Adds `out`, the sum of `amount` over all rows before in the order of `keys`, which must be different rows."""
    laid = settle(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    parts = laid.groupBy("_part").agg(F.sum(amount).alias("_whole"))
    parts = parts.select("_part", (F.sum("_whole").over(Window.orderBy("_part")) - F.col("_whole")).alias("_earlier"))
    within = F.sum(amount).over(Window.partitionBy("_part").orderBy(*keys)) - F.col(amount)
    # One row per partition, so its size is bounded by their number.
    whole = laid.withColumn("_within", within).join(F.broadcast(parts), "_part")
    return whole.withColumn(out, F.col("_earlier") + F.col("_within")).drop("_part", "_earlier", "_within")
