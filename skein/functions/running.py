"""Running sums and exact percentiles per key that no hot key holds in one task.

Rows are range-partitioned by key and order, so a key of very many rows lies in several parts: sums per part and
key, then within a part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.shared import settle


def running(frame: DataFrame, keys: list[str], order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its amount over the key's rows before, 0 for the first. `order` is total within a key.

    Null keys form a key. Null amounts count as 0.
    """
    names = list(amounts)
    rows = frame.withColumns({f"_{n}": F.coalesce(a, F.lit(0)).cast("long") for n, a in amounts.items()})
    rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    laid = settle(rows.withColumn("_part", F.spark_partition_id()))
    sums = laid.groupBy("_part", *keys).agg(*[F.sum(f"_{n}").alias(f"_sum_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names])
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in names})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_part") == F.col("_of"))
    # Without keys there is one row per part; with keys one more for each key, so that side is shuffled.
    joined = laid.join(sums if keys else F.broadcast(sums), same)
    return joined.select(*[c for c in frame.columns if c not in names], *[(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(n) for n in names])


def percentiles(frame: DataFrame, keys: list[str], column: str, ranks: dict[str, Column]) -> DataFrame:
    """Per key the values at the given ranks (from 1, expressions of `n`, the key's rows), `n`, least and most.

    Equal values are counted first, so what is ordered is one row for each different value of a key. Nulls aren't values.
    """
    counts = frame.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_count"))
    placed = running(counts, keys, [column], {"_before": F.col("_count")})
    whole = counts.groupBy(*keys).agg(F.sum("_count").alias("n"), F.min(column).alias("least"), F.max(column).alias("most"))
    own = whole.select(*[F.col(k).alias(f"_own_{k}") for k in keys], "n", "least", "most")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys])
    joined = placed.join(own, same)
    at = lambda rank: F.max(F.when((F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_count")), F.col(column)))
    one = [F.max(c).alias(c) for c in ("n", "least", "most")]
    return joined.groupBy(*keys).agg(*one, *[at(rank).alias(name) for name, rank in ranks.items()])


def nearest(p: float) -> Column:
    """The rank of a percentile by nearest rank."""
    return F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1))


def floor_rank(p: float) -> Column:
    """The rank of place min(n - 1, floor(n * p)) from 0."""
    return F.least(F.col("n"), F.floor(F.col("n") * F.lit(p)) + 1)
