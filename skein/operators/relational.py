"""Scans, filters, joins, aggregates, windows, paging and subqueries as named queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein import functions as X
from skein.operators.registry import query
from skein.sources.tables import cents, load, micros

WEEK = ("2024-01-12", "2024-01-19")
#: A keyset cursor: time and id of the last row of a page.
CURSOR = ("2024-01-10 00:00:00", 3000)
#: Parts over which the waiters of one lock are dealt.
SALTS = 8


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _in_week(column: str = "ts"):
    return (F.col(column) >= _ntz(WEEK[0])) & (F.col(column) < _ntz(WEEK[1]))


# Scans and sources.


@query("SELECT count(*) AS n FROM orders")
def scan_count(spark, sf):
    return load(spark, sf, "orders").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status FROM orders")
def project_alias(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, sf):
    return load(spark, sf, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 5, 9, 14, 100, 733)")
def any_array(spark, sf):
    return load(spark, sf, "orders").where(F.col("o_orderkey").isin(1, 5, 9, 14, 100, 733)).select("o_orderkey", "o_custkey")


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def json_extract(spark, sf):
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    """SELECT event_type, count(*) AS lines, count(*) FILTER (WHERE line LIKE 'took%' OR line LIKE '%ms=%') AS parsed FROM
    (SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'took ' || event_id || ' for ' || event_type WHEN 1 THEN event_type || ' ms=' || event_id
     WHEN 2 THEN 'finished: ' || event_type ELSE '' END AS line FROM events) GROUP BY event_type"""
)
def log_regex_parse(spark, sf):
    from skein.sources.logs import field_in_text

    line = F.expr(
        """CASE event_id % 4 WHEN 0 THEN 'took ' || event_id || ' for ' || event_type WHEN 1 THEN event_type || ' ms=' || event_id
        WHEN 2 THEN 'finished: ' || event_type ELSE '' END"""
    )
    took = field_in_text(F.col("line"), [r"^took (\d+) ", r" ms=(\d+)$"])
    return load(spark, sf, "events").select("event_type", line.alias("line")).groupBy("event_type").agg(F.count("*").alias("lines"), F.count(took).alias("parsed"))


@query("SELECT unnest([1, 2, 3]) AS product_id, unnest(['a', 'b', 'c']) AS name, unnest([100, 250, 5]) AS price")
def unnest_zip(spark, sf):
    return spark.sql("SELECT inline(arrays_zip(array(1, 2, 3), array('a', 'b', 'c'), array(100, 250, 5)))").toDF("product_id", "name", "price")


@query("SELECT * FROM (VALUES ('eu', 1), ('us', 2), ('apac', 3)) AS t(region, tenant)")
def values_source(spark, sf):
    return spark.sql("SELECT * FROM VALUES ('eu', 1), ('us', 2), ('apac', 3) AS t(region, tenant)")


# Filters.


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def filter_conj(spark, sf):
    return load(spark, sf, "orders").where("o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'").select("o_orderkey", "o_custkey")


@query(
    """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate < timestamp '1996-01-01')
    ORDER BY o_orderdate, o_orderkey LIMIT 25"""
)
def filter_claimable(spark, sf):
    stale = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < _ntz("1996-01-01"))
    return load(spark, sf, "orders").where((F.col("o_orderstatus") == "P") | stale).orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey")


@query(
    f"""SELECT user_id, count(*) AS n, cast(sum(cast(round(value * 100) AS bigint)) AS bigint) AS total_cents,
    avg(cast(round(value * 100) AS bigint)) AS mean_cents FROM events WHERE ts >= timestamp '{WEEK[0]}' AND ts < timestamp '{WEEK[1]}' GROUP BY user_id"""
)
def range_window_agg(spark, sf):
    rows = load(spark, sf, "events").where(_in_week())
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(cents("value")).alias("total_cents"), F.avg(cents("value")).alias("mean_cents"))


@query("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def left_join_null(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey")
    return load(spark, sf, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query(
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS what FROM events)
    SELECT a.event_id AS waiter, b.event_id AS holder FROM e a JOIN e b ON a.user_id = b.user_id AND a.what IS NOT DISTINCT FROM b.what AND a.event_id <> b.event_id"""
)
def nullsafe_join(spark, sf):
    """Pairs of different events of one user and kind, where every seventh event has no kind, which equals itself."""
    rows = load(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("what"))
    # One side is dealt over salts and the other stands once under each, so a hot user is several tasks.
    a = rows.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int")).alias("a")
    b = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("b")
    same = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.salt") == F.col("b.salt")) & F.col("a.what").eqNullSafe(F.col("b.what"))
    return a.join(b, same & (F.col("a.event_id") != F.col("b.event_id"))).select(F.col("a.event_id").alias("waiter"), F.col("b.event_id").alias("holder"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN cast(json_extract_string(props, '$.k') AS bigint) END AS k FROM events)
    SELECT a.event_id AS waiter, b.event_id AS holder FROM e a JOIN e b ON a.user_id = b.user_id AND a.k IS NOT DISTINCT FROM b.k AND a.event_id <> b.event_id
    WHERE a.event_type = 'error' AND b.event_type = 'purchase'"""
)
def blocked_edges(spark, sf):
    """Requests not granted (error) and the granted ones (purchase) that hold the same lock (user and k, null for none), over all events."""
    k = F.when(F.col("event_id") % 7 != 0, F.get_json_object("props", "$.k").cast("long")).alias("k")
    rows = load(spark, sf, "events").select("event_id", "user_id", "event_type", k)
    # Waiters are dealt over salts and holders stand once under each, so a hot user is several tasks.
    a = rows.where("event_type = 'error'").withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int")).alias("a")
    b = rows.where("event_type = 'purchase'").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("b")
    same = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.salt") == F.col("b.salt")) & F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.event_id") != F.col("b.event_id"))
    return a.join(b, same).select(F.col("a.event_id").alias("waiter"), F.col("b.event_id").alias("holder"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('P', 'O')")
def filter_in_list(spark, sf):
    return load(spark, sf, "orders").where(F.col("o_orderstatus").isin("P", "O")).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)")
def in_subquery_topn(spark, sf):
    orders = load(spark, sf, "orders")
    top = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey")
    return orders.join(top, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query(
    """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN
    (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5)))"""
)
def nested_semi(spark, sf):
    small = load(spark, sf, "part").where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    lines = load(spark, sf, "lineitem").where("l_quantity >= 49").join(small, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    buyers = load(spark, sf, "orders").join(lines, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf, "customer").join(buyers, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'click') GROUP BY event_type")
def not_in_list(spark, sf):
    return load(spark, sf, "events").where(~F.col("event_type").isin("error", "click")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)")
def not_exists_anti(spark, sf):
    large = load(spark, sf, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf, "orders").join(large, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'")
def like_prefix(spark, sf):
    return load(spark, sf, "part").where(F.col("p_name").like("red%")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042')")
def ci_lookup(spark, sf):
    return load(spark, sf, "customer").where(F.lower("c_name") == F.lower(F.lit("CUSTOMER#000000042"))).select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) = timestamp '1997-03-01'")
def month_trunc_filter(spark, sf):
    return load(spark, sf, "orders").where(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz") == _ntz("1997-03-01")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= timestamp '1997-03-01' AND o_orderdate < timestamp '1997-04-01'")
def month_range_filter(spark, sf):
    return load(spark, sf, "orders").where(X.month_range("o_orderdate", "1997-03-01")).select("o_orderkey")


@query(
    """WITH spent AS (SELECT o_custkey, sum(cast(round(o_totalprice * 100) AS bigint)) AS spent_cents FROM orders GROUP BY o_custkey)
    SELECT o_custkey, cast(spent_cents AS bigint) AS spent_cents FROM spent WHERE spent_cents > (SELECT avg(spent_cents) FROM spent)"""
)
def above_average(spark, sf):
    spent = load(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("spent_cents"))
    mean = spent.agg(F.avg("spent_cents").alias("mean"))  # one row
    return spent.join(F.broadcast(mean), F.col("spent_cents") > F.col("mean")).select("o_custkey", "spent_cents")


# Joins.


@query(
    """SELECT l_orderkey, l_linenumber, c_name, p_name, cast(round(l_extendedprice * 100) AS bigint) AS price_cents FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price_cents LIMIT 5"""
)
def join4_detail(spark, sf):
    return _detail(spark, sf).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_cents").limit(5).select("l_orderkey", "l_linenumber", "c_name", "p_name", "price_cents")


def _detail(spark, sf):
    lines, orders = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    joined = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.join(load(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).withColumn("price_cents", cents("l_extendedprice"))


@query("SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey")
def join4_count(spark, sf):
    return _detail(spark, sf).agg(F.count("*").alias("n"))


@query(
    """SELECT c_mktsegment, count(*) AS n_lines, cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS bigint) AS revenue_cents
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderdate >= timestamp '1997-03-01' AND o_orderdate < timestamp '1997-04-01' GROUP BY c_mktsegment"""
)
def window_report(spark, sf):
    orders = load(spark, sf, "orders").where(X.month_range("o_orderdate", "1997-03-01"))
    joined = orders.join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(load(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_lines"), F.sum(cents("l_extendedprice")).alias("revenue_cents"))


@query(
    """WITH per_order AS (SELECT l_orderkey, sum(cast(round(l_extendedprice * 100) AS bigint)) AS cents FROM lineitem GROUP BY l_orderkey)
    SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, cast(sum(cents) AS bigint) AS revenue_cents FROM customer JOIN orders ON o_custkey = c_custkey
    JOIN per_order ON l_orderkey = o_orderkey GROUP BY c_custkey, c_name ORDER BY revenue_cents DESC, c_custkey LIMIT 10"""
)
def fanout_fixed(spark, sf):
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("cents"))
    per = load(spark, sf, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.sum("cents").alias("revenue_cents"))
    named = per.join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return named.orderBy(F.desc("revenue_cents"), "c_custkey").limit(10).select("c_custkey", "c_name", "n_orders", "revenue_cents")


@query(
    """SELECT c_custkey, count(o_orderkey) AS n_orders, count(DISTINCT o_orderkey) AS n_distinct, cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS bigint) AS revenue_cents
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey ORDER BY revenue_cents DESC, c_custkey LIMIT 10"""
)
def fanout_naive(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey", cents("l_extendedprice").alias("cents"))
    joined = load(spark, sf, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    per = joined.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"), F.countDistinct("o_orderkey").alias("n_distinct"), F.sum("cents").alias("revenue_cents"))
    known = per.join(load(spark, sf, "customer").select("c_custkey"), "c_custkey", "left_semi")
    return known.orderBy(F.desc("revenue_cents"), "c_custkey").limit(10)


@query("SELECT event_id, o_orderkey, o_orderstatus FROM events JOIN orders ON o_orderkey = event_id WHERE event_type = 'purchase'")
def outbox_join(spark, sf):
    events = load(spark, sf, "events").where("event_type = 'purchase'").select("event_id")
    return events.join(load(spark, sf, "orders"), F.col("o_orderkey") == F.col("event_id")).select("event_id", "o_orderkey", "o_orderstatus")


@query(
    """WITH edge AS (SELECT DISTINCT user_id % 40 AS waiter, cast(json_extract_string(props, '$.k') AS bigint) % 40 AS holder FROM events)
    SELECT a.waiter, a.holder FROM edge a JOIN edge b ON a.waiter = b.holder AND a.holder = b.waiter WHERE a.waiter < a.holder"""
)
def two_cycle(spark, sf):
    holder = F.get_json_object("props", "$.k").cast("long") % 40
    edge = load(spark, sf, "events").select((F.col("user_id") % 40).alias("waiter"), holder.alias("holder")).distinct()
    back = edge.select(F.col("holder").alias("waiter"), F.col("waiter").alias("holder"))
    return edge.join(back, ["waiter", "holder"], "left_semi").where("waiter < holder")


@query(
    """WITH edge AS (SELECT DISTINCT user_id AS waiter, cast(json_extract_string(props, '$.k') AS bigint) AS holder FROM events)
    SELECT a.waiter, a.holder FROM edge a JOIN edge b ON a.waiter = b.holder AND a.holder = b.waiter WHERE a.waiter < a.holder"""
)
def two_cycle_whole(spark, sf):
    """Cycles of two between whole ids: each user waits for the ids k of its events."""
    holder = F.get_json_object("props", "$.k").cast("long").alias("holder")
    edge = load(spark, sf, "events").select(F.col("user_id").alias("waiter"), holder).distinct()
    back = edge.select(F.col("holder").alias("waiter"), F.col("waiter").alias("holder"))
    return edge.join(back, ["waiter", "holder"], "left_semi").where("waiter < holder")


@query(
    """WITH j AS (SELECT event_id, user_id, ts AS start, ts + interval 30 minute AS stop FROM events)
    SELECT a.event_id AS first_id, b.event_id AS second_id FROM j a JOIN j b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.start < b.stop AND b.start < a.stop"""
)
def interval_overlap(spark, sf):
    # Intervals are dealt to the hours they touch, so a user with very many of them is not compared all with all.
    j = load(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("start"), F.expr("ts + interval 30 minutes").alias("stop"))
    hour = lambda c: F.floor(micros(c) / 3_600_000_000)
    dealt = j.select("*", F.explode(F.sequence(hour("start"), hour("stop"))).alias("hour"), hour("start").alias("own"))
    a, b = dealt.alias("a"), dealt.alias("b")
    meet = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.hour") == F.col("b.hour")) & (F.col("a.event_id") < F.col("b.event_id"))
    meet = meet & (F.col("a.start") < F.col("b.stop")) & (F.col("b.start") < F.col("a.stop")) & (F.col("a.hour") == F.greatest("a.own", "b.own"))
    return a.join(b, meet).select(F.col("a.event_id").alias("first_id"), F.col("b.event_id").alias("second_id"))


# Aggregates.


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_filtered(spark, sf):
    return load(spark, sf, "orders").where("o_orderstatus = 'F'").agg(F.count("*").alias("n"))


@query(
    """SELECT o_custkey, count(DISTINCT o_orderkey) AS n_orders, cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS bigint) AS revenue_cents
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey"""
)
def customer_revenue(spark, sf):
    # Each order's lines are summed first, so an order counts once without a distinct count.
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("cents"))
    joined = load(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("cents").alias("revenue_cents"))


@query(
    """SELECT p_type, cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS bigint) AS revenue_cents, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS units
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type"""
)
def category_revenue(spark, sf):
    per = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(cents("l_extendedprice")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("units"))
    joined = per.join(load(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy("p_type").agg(F.sum("cents").alias("revenue_cents"), F.sum("units").alias("units"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE value > 50) AS n_large FROM events GROUP BY user_id")
def agg_filter(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_error"), F.count_if(F.col("value") > 50).alias("n_large"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_two_keys(spark, sf):
    return load(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def having_dups(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf):
    return load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    """WITH per_order AS (SELECT l_orderkey, sum(cast(round(l_extendedprice * 100) AS bigint)) AS cents FROM lineitem GROUP BY l_orderkey),
    per_customer AS (SELECT o_custkey, sum(cents) AS cents FROM orders JOIN per_order ON l_orderkey = o_orderkey GROUP BY o_custkey)
    SELECT c_nationkey, count(*) AS customers, cast(sum(cents) AS bigint) AS revenue_cents FROM per_customer JOIN customer ON c_custkey = o_custkey
    GROUP BY c_nationkey ORDER BY revenue_cents DESC, c_nationkey LIMIT 5"""
)
def cte_chain_top5(spark, sf):
    per = customer_revenue(spark, sf).join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return per.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("revenue_cents").alias("revenue_cents")).orderBy(F.desc("revenue_cents"), "c_nationkey").limit(5)


@query("SELECT event_type, count(*) AS n, avg(cast(round(value * 100) AS bigint)) AS mean_cents FROM events GROUP BY event_type")
def device_alltime(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(cents("value")).alias("mean_cents"))


@query(
    """SELECT date_trunc('month', o_orderdate) AS month, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS label, count(*) AS n
    FROM orders GROUP BY 1, 2 ORDER BY n DESC, month LIMIT 1"""
)
def busiest_month(spark, sf):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    per = load(spark, sf, "orders").groupBy(month.alias("month")).agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), "month").limit(1).select("month", F.date_format("month", "yyyy-MM").alias("label"), "n")


@query(
    """WITH b AS (SELECT min(ts) AS low, max(ts) AS high FROM events), m AS (SELECT make_timestamp((epoch_us(low) + epoch_us(high)) // 2) AS middle FROM b)
    SELECT count(*) AS n FROM events, m WHERE ts >= middle - interval 84 hour AND ts < middle + interval 84 hour"""
)
def middle_week_window(spark, sf):
    events = load(spark, sf, "events")
    low, high = events.agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    # Bounds of ts itself, which the scan can use.
    at = lambda n: F.timestamp_micros(F.lit(n)).cast("timestamp_ntz")
    half = 84 * 3_600_000_000
    middle = ((low or 0) + (high or 0)) // 2
    return events.where((F.col("ts") >= at(middle - half)) & (F.col("ts") < at(middle + half))).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'P') / count(*) AS selectivity FROM orders")
def selectivity(spark, sf):
    return load(spark, sf, "orders").agg((F.count_if(F.col("o_orderstatus") == "P") / F.count("*")).alias("selectivity"))


# Windows.


@query(
    """SELECT o_orderkey, o_custkey, cast(sum(cast(round(o_totalprice * 100) AS bigint)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS bigint) AS running_cents FROM orders"""
)
def running_total(spark, sf):
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.sum(cents("o_totalprice")).over(own).alias("running_cents"))


@query(
    """SELECT o_custkey, date_trunc('month', o_orderdate) AS month,
    cast(sum(sum(cast(round(o_totalprice * 100) AS bigint))) OVER (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate)) AS bigint) AS running_cents
    FROM orders GROUP BY o_custkey, date_trunc('month', o_orderdate)"""
)
def running_total_nested(spark, sf):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    per = load(spark, sf, "orders").groupBy("o_custkey", month.alias("month")).agg(F.sum(cents("o_totalprice")).alias("cents"))
    return per.select("o_custkey", "month", F.sum("cents").over(Window.partitionBy("o_custkey").orderBy("month")).alias("running_cents"))


@query(
    """SELECT c_nationkey, cast(sum(cast(round(c_acctbal * 100) AS bigint)) AS bigint) AS balance_cents,
    rank() OVER (ORDER BY sum(cast(round(c_acctbal * 100) AS bigint)) DESC) AS place FROM customer GROUP BY c_nationkey"""
)
def rank_customers(spark, sf):
    # Aggregated first: the window without partitions has one row per nation.
    per = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum(cents("c_acctbal")).alias("balance_cents"))
    return per.withColumn("place", F.rank().over(Window.orderBy(F.desc("balance_cents"))).cast("long"))


@query(
    """WITH per_customer AS (SELECT o_custkey, sum(cast(round(l_extendedprice * 100) AS bigint)) AS cents FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)
    SELECT c_custkey, c_name, cast(cents AS bigint) AS revenue_cents, rank() OVER (ORDER BY cents DESC) AS place FROM per_customer JOIN customer ON c_custkey = o_custkey"""
)
def spend_rank(spark, sf):
    """All customers with order lines by revenue. Ranks are prefix sums over ranges of the revenues; ties share the first place."""
    per = customer_revenue(spark, sf).join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "revenue_cents")
    sums = per.groupBy("revenue_cents").agg(F.count("*").alias("n"))
    # Constants, so that both uses of the ranges agree; they only balance the ranges.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sums.approxQuantile("revenue_cents", [i / parts for i in range(1, parts)], 0.001)
    above = F.array_size(F.filter(F.lit(bounds), lambda b: b > F.col("revenue_cents"))) if bounds else F.lit(0)
    sums = sums.withColumn("part", above)
    parts = sums.groupBy("part").agg(F.sum("n").alias("whole"))  # one row per range
    parts = parts.select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("earlier"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("revenue_cents"))) - F.col("n")
    places = sums.withColumn("within", within).join(F.broadcast(parts), "part").select("revenue_cents", (F.col("earlier") + F.col("within") + 1).alias("place"))
    return per.join(places, "revenue_cents").select("c_custkey", "c_name", "revenue_cents", "place")


# Order, limits and pages.


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_topk(spark, sf):
    return load(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "event_type")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 12 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def recent_for_customer(spark, sf):
    return load(spark, sf, "orders").where("o_custkey = 12").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def pending_topk(spark, sf):
    return load(spark, sf, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 20 OFFSET 400")
def offset_page(spark, sf):
    return load(spark, sf, "events").select("event_id", "ts").orderBy("ts", "event_id").offset(400).limit(20)


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 20")
def keyset_first(spark, sf):
    return load(spark, sf, "events").select("event_id", "ts").orderBy("ts", "event_id").limit(20)


@query(f"SELECT event_id, ts FROM events WHERE ts > timestamp '{CURSOR[0]}' OR (ts = timestamp '{CURSOR[0]}' AND event_id > {CURSOR[1]}) ORDER BY ts, event_id LIMIT 20")
def keyset_page(spark, sf):
    after = X.keyset_after([("ts", "timestamp_ntz", CURSOR[0]), ("event_id", "long", CURSOR[1])])
    return load(spark, sf, "events").select("event_id", "ts").where(after).orderBy("ts", "event_id").limit(20)


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 1 OFFSET 399")
def cursor_at_offset(spark, sf):
    return load(spark, sf, "events").select("event_id", "ts").orderBy("ts", "event_id").offset(399).limit(1)


@query(
    """WITH own AS (SELECT cast(o_orderkey AS bigint) AS order_id, o_orderstatus AS status FROM orders WHERE o_custkey = -1)
    SELECT * FROM (SELECT * FROM own UNION ALL SELECT cast(0 AS bigint), 'none' WHERE NOT EXISTS (SELECT 1 FROM own)) LIMIT 1"""
)
def union_all_fallback(spark, sf):
    own = load(spark, sf, "orders").where("o_custkey = -1").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status")).limit(1)
    other = spark.sql("SELECT 0L AS order_id, 'none' AS status")
    return own.unionByName(other.join(own.select(F.lit(1).alias("one")), F.lit(True), "left_anti")).limit(1)
