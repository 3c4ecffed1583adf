"""Scalar functions, percentiles and log roll-ups as named queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein import functions as X
from skein.functions import running
from skein.operators.registry import query
from skein.sources.tables import cents, load, micros

CENTS = "cast(round(value * 100) AS bigint)"


@query("SELECT c_nationkey, cast(coalesce(sum(cast(round(c_acctbal * 100) AS bigint)) FILTER (WHERE c_mktsegment = 'BUILDING'), 0) AS bigint) AS total_cents FROM customer GROUP BY c_nationkey")
def coalesce_sum(spark, sf):
    own = F.when(F.col("c_mktsegment") == "BUILDING", cents("c_acctbal"))
    return load(spark, sf, "customer").groupBy("c_nationkey").agg(F.coalesce(F.sum(own), F.lit(0)).alias("total_cents"))


@query(
    """SELECT user_id, round(cast(100 AS double) * count(*) FILTER (WHERE event_type = 'error') / nullif(count(*) FILTER (WHERE event_type <> 'click'), 0), 1) AS percent
    FROM events GROUP BY user_id"""
)
def safe_ratio(spark, sf):
    errors, others = F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") != "click")
    return load(spark, sf, "events").groupBy("user_id").agg(F.round(F.lit(100.0) * errors / F.nullif(others, F.lit(0)), 1).alias("percent"))


@query("SELECT c_custkey, greatest(cast(round(c_acctbal * 100) AS bigint) - 500000, 0) AS left_cents FROM customer")
def clamp_nonneg(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", F.greatest(cents("c_acctbal") - 500000, F.lit(0)).alias("left_cents"))


@query("SELECT c_custkey, left(c_mktsegment, 3) AS short FROM customer")
def str_left(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", F.left("c_mktsegment", F.lit(3)).alias("short"))


@query(
    """SELECT c_custkey, CASE WHEN bits >= 2147483648 THEN bits - 4294967296 ELSE bits END AS lock_key
    FROM (SELECT c_custkey, cast('0x' || substr(md5(c_name), 1, 8) AS bigint) AS bits FROM customer)"""
)
def md5_key(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", X.signed_md5_key("c_name").alias("lock_key"))


@query("SELECT event_id, ts + interval 30 second AS deadline, ts + interval 30 second < timestamp '2024-01-15' AS expired FROM events")
def lease_deadline(spark, sf):
    deadline = F.expr("ts + interval 30 seconds")
    return load(spark, sf, "events").select("event_id", deadline.alias("deadline"), (deadline < F.lit("2024-01-15").cast("timestamp_ntz")).alias("expired"))


@query("SELECT event_id FROM events WHERE ts >= timestamp '2024-01-20' - interval 2 hour AND ts < timestamp '2024-01-20'")
def interval_filter(spark, sf):
    return load(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-20' - interval 2 hours AND ts < timestamp_ntz'2024-01-20'").select("event_id")


@query("SELECT event_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1000 AS lag_ms FROM events")
def lag_ms(spark, sf):
    return load(spark, sf, "events").select("event_id", ((micros("ts") - F.lit(1704067200000000)) / 1000).alias("lag_ms"))


@query(
    """WITH l AS (SELECT event_id, user_id, ts, sum(strlen(props)) OVER (ORDER BY ts, event_id) AS position FROM events)
    SELECT event_id, cast(position - lag(position, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS lag_bytes,
    position - lag(position, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2048 AS caught_up FROM l"""
)
def lag_bytes(spark, sf):
    """Positions in the log of all events, in bytes; each user is a reader that has read up to its last event."""
    rows = load(spark, sf, "events").select("event_id", "user_id", "ts", F.octet_length("props").alias("bytes"))
    placed = running.running(rows, [], ["ts", "event_id"], {"before": F.col("bytes")}).withColumn("position", F.col("before") + F.col("bytes"))
    lag = F.col("position") - F.lag("position", 1, 0).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return placed.select("event_id", lag.alias("lag_bytes"), (lag <= 2048).alias("caught_up"))


@query("SELECT event_id, event_type AS what, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def json_roundtrip(spark, sf):
    made = F.to_json(F.struct(F.col("event_type").alias("what"), F.get_json_object("props", "$.k").cast("long").alias("k")))
    back = F.from_json(made, "what string, k long")
    return load(spark, sf, "events").select("event_id", back.alias("j")).select("event_id", "j.what", "j.k")


@query("SELECT user_id, count(*) AS n, round(1 - exp(-cast(count(*) AS double) * (count(*) - 1) / 8589934592.0), 9) AS probability FROM events GROUP BY user_id")
def collision_prob(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", "n", F.round(X.collision_probability(F.col("n"), 32), 9).alias("probability"))


@query("SELECT a AS attempt, least(cast(5000 AS double), cast(100 AS double) * pow(2, a - 1)) AS wait_ms FROM (SELECT unnest(range(1, 9)) AS a)")
def backoff_cap(spark, sf):
    return spark.range(1, 9).select(F.col("id").alias("attempt"), X.backoff(F.col("id"), 100, 5000).alias("wait_ms"))


@query("SELECT o_orderkey, (cast(round(o_totalprice * 100) AS bigint) * 29 + 500) // 1000 + 30 AS fee FROM orders")
def fee_cents(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", X.fee_cents(cents("o_totalprice")).alias("fee"))


def _summary(what: str) -> str:
    return f"""SELECT {what} count(*) AS n, quantile_disc({CENTS}, 0.5) AS p50, quantile_disc({CENTS}, 0.95) AS p95, quantile_disc({CENTS}, 0.99) AS p99,
    min({CENTS}) AS least, max({CENTS}) AS most FROM events"""


def _summaries(rows, keys: list[str]):
    return running.percentiles(rows, keys, "cents", {f"p{round(p * 100)}": running.nearest(p) for p in (0.5, 0.95, 0.99)})


@query(_summary("event_type,") + " GROUP BY event_type")
def latency_percentiles(spark, sf):
    return _summaries(load(spark, sf, "events").select("event_type", cents("value").alias("cents")), ["event_type"])


@query(
    f"""SELECT user_id % 10 AS route, count(*) AS total, round(cast(count(*) FILTER (WHERE event_type = 'error') AS double) / count(*), 4) AS error_rate,
    quantile_disc({CENTS}, 0.5) AS p50, quantile_disc({CENTS}, 0.95) AS p95, quantile_disc({CENTS}, 0.99) AS p99, min({CENTS}) AS least, max({CENTS}) AS most
    FROM events GROUP BY user_id % 10"""
)
def route_rollup(spark, sf):
    rows = load(spark, sf, "events").select((F.col("user_id") % 10).alias("route"), "event_type", cents("value").alias("cents"))
    rate = F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 4)
    per = rows.groupBy("route").agg(F.count("*").alias("total"), rate.alias("error_rate"))
    return per.join(_summaries(rows, ["route"]).drop("n"), "route")


@query(
    f"""SELECT event_type, {CENTS} AS p50_cents FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {CENTS}, event_id) AS r,
    count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = least(n, floor(n * 0.5) + 1)"""
)
def percentile_floor_index(spark, sf):
    rows = load(spark, sf, "events").select("event_type", cents("value").alias("cents"))
    return running.percentiles(rows, ["event_type"], "cents", {"p50_cents": running.floor_rank(0.5)}).select("event_type", "p50_cents")


@query(
    f"""SELECT user_id, {CENTS} AS median_cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {CENTS}, event_id) AS r,
    count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n % 2 = 1 AND r = n // 2 + 1"""
)
def upper_median_odd(spark, sf):
    """The middle value of users with an odd number of events."""
    rows = load(spark, sf, "events").select("user_id", cents("value").alias("cents"))
    return running.percentiles(rows, ["user_id"], "cents", {"median_cents": running.floor_rank(0.5)}).where("n % 2 = 1").select("user_id", "median_cents")


@query(f"SELECT user_id, median({CENTS}) AS median_cents FROM events GROUP BY user_id")
def median_by_key(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.median(cents("value")).alias("median_cents"))


@query(
    f"""SELECT event_type, le, count(*) FILTER (WHERE {CENTS} <= le * 100) AS n FROM events, (SELECT unnest({X.HISTOGRAM_BOUNDS}) AS le) GROUP BY event_type, le"""
)
def histogram_buckets(spark, sf):
    # One pass counts all bounds; only the counts are turned into rows.
    counts = [F.count_if(cents("value") <= b * 100).alias(f"b{b}") for b in X.HISTOGRAM_BOUNDS]
    wide = load(spark, sf, "events").groupBy("event_type").agg(*counts)
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("n")) for b in X.HISTOGRAM_BOUNDS])
    return wide.select("event_type", F.inline(rows))


@query(
    """SELECT event_type, avg(gap) AS mean_us, min(gap) AS least_us, max(gap) AS most_us FROM
    (SELECT event_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY event_type"""
)
def lag_summary(spark, sf):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gaps = load(spark, sf, "events").select("event_type", (micros("ts") - F.lag(micros("ts")).over(own)).alias("gap"))
    return gaps.groupBy("event_type").agg(F.avg("gap").alias("mean_us"), F.min("gap").alias("least_us"), F.max("gap").alias("most_us"))


@query("SELECT user_id % 10 AS route, cast(100 AS double) * count(*) FILTER (WHERE value > 50) / count(*) AS percent FROM events GROUP BY user_id % 10")
def route_rate(spark, sf):
    return load(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("route")).agg((F.lit(100.0) * F.count_if(F.col("value") > 50) / F.count("*")).alias("percent"))


@query(
    """SELECT user_id, count(*) AS entries, string_agg(DISTINCT 'k' || (cast(json_extract_string(props, '$.k') AS bigint) % 5), ',' ORDER BY 'k' || (cast(json_extract_string(props, '$.k') AS bigint) % 5)) AS actors
    FROM events GROUP BY user_id"""
)
def saga_log_stats(spark, sf):
    actor = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string"))
    return load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("entries"), F.array_join(F.array_sort(F.collect_set(actor)), ",").alias("actors"))


@query(
    """WITH k AS (SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' WHEN event_type = 'error' THEN 'transaction'
        WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IN ('purchase', 'signup') THEN 'read-after-write' ELSE 'read' END AS kind FROM events)
    SELECT event_id, kind, CASE kind WHEN 'write' THEN 'primary' ELSE 'replica' END AS naive, CASE kind WHEN 'read' THEN 'replica' ELSE 'primary' END AS target FROM k"""
)
def route_classify(spark, sf):
    """Where each request goes: a read just after the same user's write must see it, so only other reads go to a replica.

    Purchases and signups stand for writes and errors for transactions; `naive` looks at writes alone.
    """
    writes, own = ["purchase", "signup"], Window.partitionBy("user_id").orderBy("ts", "event_id")
    read = F.when(F.lag("event_type").over(own).isin(writes), "read-after-write").otherwise("read")
    kind = F.when(F.col("event_type").isin(writes), "write").when(F.col("event_type") == "error", "transaction").otherwise(read)
    naive, target = F.when(F.col("kind") == "write", "primary").otherwise("replica"), F.when(F.col("kind") == "read", "replica").otherwise("primary")
    return load(spark, sf, "events").select("event_id", kind.alias("kind")).select("event_id", "kind", naive.alias("naive"), target.alias("target"))


@query(
    """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id)
    SELECT user_id % 10 AS team, count(*) FILTER (WHERE state = 'signup') AS on_call, count(*) FILTER (WHERE state = 'signup') > 0 AS holds FROM l GROUP BY user_id % 10"""
)
def on_call_count(spark, sf):
    """Staff on call per team and whether the invariant of at least one holds; a signup takes up duty and an error gives it up."""
    log = load(spark, sf, "events").where(F.col("event_type").isin("signup", "error"))
    last = log.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    on_call = F.count_if(F.col("state") == "signup")
    return last.groupBy((F.col("user_id") % 10).alias("team")).agg(on_call.alias("on_call"), (on_call > 0).alias("holds"))
