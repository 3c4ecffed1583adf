"""Logs of attempts, sagas, claims and queues, folded from the rows of events in each user's order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions.running import running
from skein.operators.registry import query
from skein.sources.tables import load, micros

ORDER = ["ts", "event_id"]
#: Attempts of a call at most, and steps of a saga in order.
MOST = 3
STEPS = ["order", "payment", "stock", "shipping"]


def _events(spark, sf, *columns):
    return load(spark, sf, "events").select("event_id", "user_id", "ts", *columns)


def _placed(spark, sf, ends):
    """run: how many rows that end one came before in the user's log; pos: the row's place in its run, from 0."""
    rows = running(_events(spark, sf, "event_type"), ["user_id"], ORDER, {"run": ends.cast("int")})
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy("user_id", "run").orderBy(*ORDER)) - 1).cast("long"))


_ATTEMPTS = """WITH r AS (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM events),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS pos FROM r),
    c AS (SELECT user_id, run, pos // 3 AS call, count(*) AS attempts, bool_or(event_type <> 'error') AS ok FROM p GROUP BY ALL) """


def _calls(spark, sf):
    """A call is tried until its first success or its third error; the next row begins another."""
    rows = _placed(spark, sf, F.col("event_type") != "error").withColumn("call", F.floor(F.col("pos") / MOST))
    return rows.groupBy("user_id", "run", "call").agg(F.count("*").alias("attempts"), F.max(F.col("event_type") != "error").alias("ok"))


@query(_ATTEMPTS + "SELECT user_id, run, call, attempts, CASE WHEN ok THEN 'succeeded' WHEN attempts = 3 THEN 'failed' ELSE 'pending' END AS outcome FROM c")
def retry_outcomes(spark, sf):
    outcome = F.when(F.col("ok"), "succeeded").when(F.col("attempts") == MOST, "failed").otherwise("pending")
    return _calls(spark, sf).select("user_id", "run", "call", "attempts", outcome.alias("outcome"))


@query(_ATTEMPTS + "SELECT event_id, pos % 3 + 1 AS attempts, CASE WHEN pos % 3 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status FROM p WHERE event_type = 'error'")
def retry_status_case(spark, sf):
    """Each failed attempt's number in its call, and whether the call may be tried again."""
    attempts = F.col("pos") % MOST + 1
    rows = _placed(spark, sf, F.col("event_type") != "error").where("event_type = 'error'")
    return rows.select("event_id", attempts.alias("attempts"), F.when(attempts >= MOST, "failed").otherwise("pending").alias("status"))


@query(_ATTEMPTS + "SELECT user_id, cast(sum(attempts) AS bigint) AS calls, count(*) AS callers, cast(sum(attempts) AS double) / count(*) AS amplification FROM c GROUP BY user_id")
def retry_amplification(spark, sf):
    """Attempts made for a user's calls."""
    per = _calls(spark, sf).groupBy("user_id").agg(F.sum("attempts").alias("calls"), F.count("*").alias("callers"))
    return per.withColumn("amplification", F.col("calls").cast("double") / F.col("callers"))


@query(
    """SELECT event_id, CASE WHEN epoch_us(after) - epoch_us(ts) <= 7200000000 THEN CASE WHEN reply = 'error' THEN 'error' ELSE 'ok' END ELSE 'timeout' END AS outcome FROM
    (SELECT *, lead(ts) OVER own AS after, lead(event_type) OVER own AS reply FROM events WINDOW own AS (PARTITION BY user_id ORDER BY ts, event_id))"""
)
def timeout_classify(spark, sf):
    """A row is answered by the user's next one; without an answer in two hours it timed out."""
    own = Window.partitionBy("user_id").orderBy(*ORDER)
    rows = _events(spark, sf, micros("ts").alias("at"), "event_type")
    rows = rows.withColumns({"after": F.lead("at").over(own), "reply": F.lead("event_type").over(own)})
    answered = F.coalesce(F.col("after") - F.col("at") <= 7_200_000_000, F.lit(False))
    return rows.select("event_id", F.when(~answered, "timeout").when(F.col("reply") == "error", "error").otherwise("ok").alias("outcome"))


@query(
    """WITH r AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM events),
    p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 4 AS saga FROM r),
    s AS (SELECT user_id, run, saga, count(*) AS n, bool_or(event_type = 'error') AS failed FROM p GROUP BY ALL)
    SELECT user_id, run, saga, CASE WHEN failed THEN 'COMPENSATED' WHEN n = 4 THEN 'COMPLETED' ELSE 'OPEN' END AS state,
    CASE WHEN failed THEN array_to_string(list_reverse(['order', 'payment', 'stock', 'shipping'][1:n - 1]), ',') ELSE '' END AS undone FROM s"""
)
def saga_outcome(spark, sf):
    """A saga takes four steps, one per row; an error ends it, and the steps done before are undone in reverse."""
    rows = _placed(spark, sf, F.col("event_type") == "error").withColumn("saga", F.floor(F.col("pos") / len(STEPS)))
    per = rows.groupBy("user_id", "run", "saga").agg(F.count("*").cast("int").alias("n"), F.max(F.col("event_type") == "error").alias("failed"))
    state = F.when(F.col("failed"), "COMPENSATED").when(F.col("n") == len(STEPS), "COMPLETED").otherwise("OPEN")
    undone = F.array_join(F.reverse(F.slice(F.array(*[F.lit(s) for s in STEPS]), F.lit(1), F.col("n") - 1)), ",")
    return per.select("user_id", "run", "saga", state.alias("state"), F.when(F.col("failed"), undone).otherwise("").alias("undone"))


_OWNED = """WITH o AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN user_id END IGNORE NULLS) OVER (PARTITION BY cast(json_extract_string(props, '$.k') AS bigint)
    ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM events) """


@query(_OWNED + "SELECT event_id, coalesce(owner = user_id, false) AS finalized FROM o WHERE event_type = 'purchase'")
def owner_finalize(spark, sf):
    """A purchase finalizes item k only for the user whose claim (view) of it was the last before."""
    rows = _events(spark, sf, "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).where("event_type in ('view', 'purchase')")
    before = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("event_type") == "view", F.col("user_id")), ignorenulls=True).over(before)
    return rows.withColumn("owner", owner).where("event_type = 'purchase'").select("event_id", F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)).alias("finalized"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY cast(ts AS date) ORDER BY ts, event_id) - 1) % 5 AS worker FROM events")
def claim_assignment(spark, sf):
    """Queues are days; within a queue the oldest go first, to each worker in turn."""
    return _claims(spark, sf).select("event_id", "worker")


def _claims(spark, sf):
    rows = running(_events(spark, sf, F.to_date("ts").alias("day")), ["day"], ORDER, {"place": F.lit(1)})
    return rows.withColumn("worker", F.col("place") % 5)


@query(
    """SELECT worker, count(*) AS claims, count(DISTINCT event_id) AS items FROM
    (SELECT event_id, (row_number() OVER (PARTITION BY cast(ts AS date) ORDER BY ts, event_id) - 1) % 5 AS worker FROM events) GROUP BY worker"""
)
def claim_counts(spark, sf):
    """Claims of each worker and how many different items they are: equal, as each item is claimed once."""
    per = _claims(spark, sf).groupBy("worker", "event_id").agg(F.count("*").alias("n"))
    return per.groupBy("worker").agg(F.sum("n").alias("claims"), F.count("*").alias("items"))


@query("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS batch FROM events WHERE event_type <> 'click'")
def outbox_batches(spark, sf):
    """The batch of a hundred in which each unpublished row is drained, oldest first, until none is left."""
    rows = running(_events(spark, sf, "event_type").where("event_type <> 'click'"), [], ORDER, {"place": F.lit(1)})
    return rows.select("event_id", F.floor(F.col("place") / 100).alias("batch"))


@query("SELECT event_id, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY ts, event_id) AS o_orderkey FROM events WHERE event_type = 'purchase'")
def insert_returning(spark, sf):
    """Keys that inserted orders get, after the largest one there is, in the order of their purchases."""
    rows = running(_events(spark, sf, "event_type").where("event_type = 'purchase'"), [], ORDER, {"place": F.lit(1)})
    last = load(spark, sf, "orders").agg(F.coalesce(F.max("o_orderkey"), F.lit(0))).first()[0]
    return rows.select("event_id", (F.col("place") + 1 + last).alias("o_orderkey"))


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 20 OFFSET (SELECT count(*) * 9 // 10 FROM events)")
def offset_page_deep(spark, sf):
    """A page nine tenths down: rows are numbered by ranges, and only the page's are kept and sorted."""
    rows = running(load(spark, sf, "events").select("event_id", "ts"), [], ORDER, {"place": F.lit(1)})
    first = rows.count() * 9 // 10
    return rows.where(F.col("place").between(first, first + 19)).select("event_id", "ts")
