"""Queries over partitioned layouts: written by range or list, read with pruning, detached, dropped and emptied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.registry import query
from skein.shared import new_dir
from skein.sources import layout
from skein.sources.tables import cents, load

REPORT = "count(*) AS n, cast(sum(cast(round(o_totalprice * 100) AS bigint)) AS bigint) AS total_cents"


def orders_by_month(spark, sf) -> str:
    """Orders written below a fresh path, one folder per month."""
    path = new_dir(spark, "orders-by-month")
    layout.write_partitioned(load(spark, sf, "orders"), path, layout.by_month("o_orderdate"), "month")
    return path


def events_by_type(spark, sf) -> str:
    """Events written below a fresh path: a folder for clicks, one for views and one for all others."""
    path = new_dir(spark, "events-by-type")
    layout.write_partitioned(load(spark, sf, "events"), path, layout.by_list("event_type", ["click", "view"]), "part")
    return path


def _months(spark, path) -> DataFrame:
    # The months stay text: they aren't dates to Spark.
    return spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))


def _report(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("total_cents"))


def _between(spark, sf, low: str, high: str) -> DataFrame:
    return _report(_months(spark, orders_by_month(spark, sf)).where(layout.between("o_orderdate", "month", low, high)))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def partition_counts(spark, sf):
    """Rows of each month's folder."""
    return _months(spark, orders_by_month(spark, sf)).groupBy("month").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '__default__' END AS part, count(*) AS n FROM events GROUP BY 1")
def list_partition_counts(spark, sf):
    """Rows of each folder of a list layout, and of its default folder."""
    return spark.read.parquet(events_by_type(spark, sf)).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type")
def default_partition(spark, sf):
    """What lies in the default folder."""
    return spark.read.parquet(events_by_type(spark, sf)).where(F.col("part") == layout.DEFAULT).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"SELECT {REPORT} FROM orders WHERE o_orderdate >= timestamp '1997-06-09' AND o_orderdate < timestamp '1997-06-16'")
def pruned_week(spark, sf):
    """A week within a month: one folder is read."""
    return _between(spark, sf, "1997-06-09", "1997-06-16")


@query(f"SELECT {REPORT} FROM orders WHERE o_orderdate >= timestamp '1997-06-28' AND o_orderdate < timestamp '1997-07-05'")
def pruned_boundary(spark, sf):
    """A week over the end of a month: two folders are read."""
    return _between(spark, sf, "1997-06-28", "1997-07-05")


@query(f"SELECT {REPORT} FROM orders WHERE o_orderdate >= timestamp '1997-01-01' AND o_orderdate < timestamp '1998-01-01'")
def pruned_year(spark, sf):
    """A year: twelve folders are read."""
    return _between(spark, sf, "1997-01-01", "1998-01-01")


@query(f"SELECT o_orderpriority, {REPORT} FROM orders GROUP BY o_orderpriority")
def unpruned_alltime(spark, sf):
    """A report by another column: every folder is read."""
    rows = _months(spark, orders_by_month(spark, sf))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("total_cents"))


@query(
    """SELECT 'left' AS what, count(*) AS n FROM orders WHERE NOT (o_orderdate >= timestamp '1997-03-01' AND o_orderdate < timestamp '1997-05-01')
    UNION ALL SELECT 'detached', count(*) FROM orders WHERE o_orderdate >= timestamp '1997-04-01' AND o_orderdate < timestamp '1997-05-01'"""
)
def detach_and_drop(spark, sf):
    """March is dropped, April detached as a table of its own."""
    path, to = orders_by_month(spark, sf), new_dir(spark, "detached")
    layout.drop_partition(spark, path, "month", "1997-03")
    layout.detach_partition(spark, path, "month", "1997-04", to)
    count = lambda what, frame: frame.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count("left", _months(spark, path)).unionByName(count("detached", spark.read.schema(load(spark, sf, "orders").schema).parquet(to)))


@query("SELECT 0::bigint AS n")
def truncated(spark, sf):
    """A layout emptied and read again."""
    path = events_by_type(spark, sf)
    layout.truncate(spark, path)
    return spark.read.parquet(path).agg(F.count("event_id").alias("n"))
