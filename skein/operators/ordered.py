"""Ordered state machines as named queries, each a fold over a key's events in time order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import folds
from skein.operators.registry import query
from skein.sources.tables import load, micros


def _events(spark, sf):
    return load(spark, sf, "events").select("event_id", "user_id", "event_type", micros("ts").alias("at"))


_ROWS = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS tick, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),"""


TOKEN_BUCKET = (
    _ROWS + """f AS (SELECT event_id, user_id, tick, n, true AS allowed, cast(2 AS double) AS tokens FROM e WHERE n = 1 UNION ALL
    SELECT event_id, user_id, tick, n, have >= 1, have - CASE WHEN have >= 1 THEN 1 ELSE 0 END FROM
    (SELECT e.*, least(cast(3 AS double), f.tokens + greatest(0, e.tick - f.tick) / cast(1000000 AS double) * (cast(1 AS double) / 14400)) AS have FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
    SELECT event_id, user_id, allowed, round(tokens, 6) AS tokens FROM f"""
)


@query(TOKEN_BUCKET)
def token_bucket(spark, sf):
    step = folds.token_bucket(capacity=3, per_second=1 / 14400)
    out = folds.fold(_events(spark, sf), "user_id", ["at", "event_id"], lambda: None, step, ["at"], "allowed boolean, tokens double")
    return out.select("event_id", "user_id", "allowed", F.round("tokens", 6).alias("tokens"))


@query(
    _ROWS + """f AS (SELECT event_id, user_id, n, true AS allowed, [tick] AS admitted FROM e WHERE n = 1 UNION ALL
    SELECT event_id, user_id, n, len(have) < 2, CASE WHEN len(have) < 2 THEN list_append(have, tick) ELSE have END FROM
    (SELECT e.*, list_filter(f.admitted, lambda t: t > e.tick - 21600000000) AS have FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
    SELECT event_id, user_id, allowed FROM f"""
)
def sliding_limiter(spark, sf):
    step = folds.sliding_log(limit=2, window_micros=6 * 3_600_000_000)
    return folds.fold(_events(spark, sf), "user_id", ["at", "event_id"], lambda: None, step, ["at"], "allowed boolean").select("event_id", "user_id", "allowed")


@query(
    _ROWS + """f AS (SELECT event_id, user_id, n, true AS ran, 'CLOSED' AS found, 'CLOSED' AS breaker_state, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failures, 0::bigint AS opened
    FROM e WHERE n = 1 UNION ALL
    SELECT event_id, user_id, n, found <> 'OPEN', found, CASE WHEN found = 'OPEN' THEN 'OPEN' WHEN event_type <> 'error' THEN 'CLOSED' WHEN found = 'HALF_OPEN' OR failures >= 1 THEN 'OPEN' ELSE 'CLOSED' END,
    CASE WHEN found = 'OPEN' THEN failures WHEN event_type <> 'error' THEN 0 ELSE failures + 1 END, CASE WHEN found <> 'OPEN' AND event_type = 'error' AND (found = 'HALF_OPEN' OR failures >= 1) THEN tick ELSE opened END
    FROM (SELECT e.*, f.failures, f.opened, CASE WHEN f.breaker_state <> 'OPEN' THEN 'CLOSED' WHEN e.tick - f.opened < 43200000000 THEN 'OPEN' ELSE 'HALF_OPEN' END AS found
    FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
    SELECT event_id, user_id, ran, found, breaker_state FROM f"""
)
def breaker_fold(spark, sf):
    rows = _events(spark, sf).withColumn("failed", F.col("event_type") == "error")
    step = folds.breaker(threshold=2, cooldown_micros=12 * 3_600_000_000)
    out = folds.fold(rows, "user_id", ["at", "event_id"], lambda: None, step, ["at", "failed"], "ran boolean, found string, breaker_state string")
    return out.select("event_id", "user_id", "ran", "found", "breaker_state")


@query(
    _ROWS + """f AS (SELECT event_id, user_id, n, event_type <> 'purchase' AS admitted, CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END::bigint AS pending FROM e WHERE n = 1 UNION ALL
    SELECT e.event_id, e.user_id, e.n, e.event_type <> 'purchase' AND f.pending < 5, CASE WHEN e.event_type = 'purchase' THEN greatest(0, f.pending - 1) ELSE least(5, f.pending + 1) END
    FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, user_id, admitted, pending FROM f"""
)
def bounded_admission(spark, sf):
    """An arrival is admitted below five pending; a purchase frees a place if one is taken."""
    rows = _events(spark, sf).withColumn("delta", F.when(F.col("event_type") == "purchase", -1).otherwise(1))
    out = folds.clamped(rows, "user_id", ["at", "event_id"], F.col("delta"), 0, 5, "pending")
    before = F.lag("pending", 1, 0).over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    return out.select("event_id", "user_id", ((F.col("delta") == 1) & (before < 5)).alias("admitted"), "pending")


_SEATS = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY seat ORDER BY tick, event_id) AS n FROM
    (SELECT event_id, user_id, event_type = 'purchase' AS sells, epoch_us(ts) AS tick, cast(json_extract_string(props, '$.k') AS bigint) AS seat FROM events WHERE event_type IN ('view', 'purchase'))),
    f AS (SELECT event_id, seat, n, tick, CASE WHEN sells THEN 'refused' ELSE 'held' END AS outcome, CASE WHEN NOT sells THEN user_id END AS holder, CASE WHEN sells THEN 0 ELSE tick + 432000000000 END AS until, false AS sold
    FROM e WHERE n = 1 UNION ALL
    SELECT event_id, seat, n, tick, CASE WHEN sells AND done THEN 'sold' WHEN done THEN 'held' ELSE 'refused' END, CASE WHEN done AND NOT sells THEN user_id ELSE holder END,
    CASE WHEN done AND NOT sells THEN tick + 432000000000 ELSE until END, sold OR (sells AND done) FROM
    (SELECT e.*, f.holder, f.until, f.sold, CASE WHEN e.sells THEN f.holder IS NOT NULL AND f.until > e.tick AND f.holder = e.user_id AND NOT f.sold
    ELSE NOT f.sold AND NOT (f.holder IS NOT NULL AND f.until > e.tick) END AS done FROM f JOIN e ON e.seat = f.seat AND e.n = f.n + 1))
    """


def _seat_log(spark, sf):
    rows = load(spark, sf, "events").where("event_type in ('view', 'purchase')")
    rows = rows.select("event_id", "user_id", (F.col("event_type") == "purchase").alias("sells"), micros("ts").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("seat"))
    return folds.fold(rows, "seat", ["at", "event_id"], lambda: None, folds.seats(5 * 86_400_000_000), ["user_id", "sells", "at"], "outcome string, holder long, until long")


@query(_SEATS + "SELECT event_id, seat, coalesce(outcome, 'refused') AS outcome FROM f")
def seat_requests(spark, sf):
    """Requests to hold (view) or buy (purchase) a seat, in order; only the holder can buy, before the hold ends."""
    return _seat_log(spark, sf).select("event_id", "seat", "outcome")


@query(
    _SEATS + """SELECT seat, CASE WHEN bool_or(sold) THEN 'SOLD' WHEN max_by(until, n) > epoch_us(timestamp '2024-01-30') THEN 'RESERVED' ELSE 'AVAILABLE' END AS state FROM f GROUP BY seat"""
)
def expire_holds(spark, sf):
    """Every seat as it stands on a day: sold, held until later, or free since its hold ended."""
    last = F.max_by("until", F.struct("at", "event_id"))
    state = F.when(F.max(F.col("outcome") == "sold"), "SOLD").when(last > 1706572800000000, "RESERVED").otherwise("AVAILABLE")
    return _seat_log(spark, sf).groupBy("seat").agg(state.alias("state"))


@query("SELECT time_bucket(interval 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window(spark, sf):
    """Tumbling windows of an hour."""
    per = load(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < interval 2 hour THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, session"""
)
def session_window(spark, sf):
    """Sessions of a user that end after two hours without events."""
    per = load(spark, sf, "events").groupBy(F.session_window(F.col("ts").cast("timestamp"), "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
