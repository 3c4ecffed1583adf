"""Upserts, deduplication, compare-and-set, ledgers, backfills, retention and row policy as named queries.

Each takes an ordered log of requests and gives the state that they leave; the first or last row of a key is found by
an aggregate of one struct, which is combined before the shuffle, so a key of very many rows is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.registry import query
from skein.shared import new_dir
from skein.sources.layout import unmatched
from skein.sources.tables import cents, load

CENTS = "cast(round(value * 100) AS bigint)"


def first_per_key(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order; null keys form a key. Columns keep their places."""
    rest = [c for c in frame.columns if c not in keys and c not in order]
    one = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")
    return frame.groupBy(*keys).agg(one).select(*keys, "_first.*").select(*frame.columns)


def last_per_key(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in frame.columns if c not in keys and c not in order]
    one = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_last")
    return frame.groupBy(*keys).agg(one).select(*keys, "_last.*").select(*frame.columns)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: `existing` and, of each key that it lacks, the first incoming row."""
    return existing.unionByName(first_per_key(incoming, keys, order).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def violations(frame: DataFrame, unique: list[str] | None = None, not_null: list[str] = (), check: str | None = None) -> DataFrame:
    """Rows or keys that break a constraint, as (constraint, key). As in SQL a check that gives null holds, and null keys are distinct."""
    key = F.to_json(F.struct(*frame.columns))
    out = [frame.where(F.col(c).isNull()).select(F.lit(f"not null {c}").alias("constraint"), key.alias("key")) for c in not_null]
    if unique:
        dup = frame.dropna(subset=unique).groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1")
        out.append(dup.select(F.lit("unique " + ", ".join(unique)).alias("constraint"), F.to_json(F.struct(*unique)).alias("key")))
    if check:
        out.append(frame.where(f"NOT ({check})").select(F.lit(f"check {check}").alias("constraint"), key.alias("key")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose key isn't null and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").select(*child.columns)


def _events(spark, sf, *columns):
    return load(spark, sf, "events").select("event_id", "ts", *columns)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def insert_ignore(spark, sf):
    incoming = _events(spark, sf, "user_id", "event_type")
    existing = incoming.where("event_id < 0")
    return insert_missing(existing, incoming, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts < timestamp '2024-01-03'),
    old AS (SELECT user_id, event_id, event_type FROM r WHERE n = 1),
    late AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts >= timestamp '2024-01-03')
    SELECT * FROM old UNION ALL SELECT user_id, event_id, event_type FROM late WHERE n = 1 AND user_id NOT IN (SELECT user_id FROM old)"""
)
def insert_ignore_stored(spark, sf):
    """Each user's first row before a date is stored; all later events are inserted and meet the stored rows."""
    events = _events(spark, sf, "user_id", "event_type")
    early = F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")
    existing = first_per_key(events.where(early), ["user_id"], ["ts", "event_id"])
    return insert_missing(existing, events.where(~early), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    f"""SELECT c_custkey AS key, coalesce(e.cents, cast(round(c_acctbal * 100) AS bigint)) AS cents, e.cents IS NOT NULL AS updated FROM customer LEFT JOIN
    (SELECT user_id, {CENTS} AS cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1) e ON e.user_id = c_custkey"""
)
def upsert_update(spark, sf):
    incoming = last_per_key(_events(spark, sf, "user_id", cents("value").alias("cents")), ["user_id"], ["ts", "event_id"])
    existing = load(spark, sf, "customer").select(F.col("c_custkey").alias("key"), cents("c_acctbal").alias("old"))
    joined = existing.join(incoming, F.col("user_id") == F.col("key"), "left")
    return joined.select("key", F.coalesce("cents", "old").alias("cents"), F.col("cents").isNotNull().alias("updated"))


@query("SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS result FROM events")
def idempotent_replay(spark, sf):
    rows = _events(spark, sf, "user_id", "event_type")
    first = rows.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("result"))
    return rows.join(first, ["user_id", "event_type"]).select("event_id", "result")


@query(
    f"""SELECT user_id, cast(sum(cents) AS bigint) AS balance_cents FROM (SELECT user_id, {CENTS} AS cents, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS r FROM events)
    WHERE r = 1 GROUP BY user_id"""
)
def inbox_balance(spark, sf):
    # A message is its user, kind and hour; later deliveries are ignored.
    rows = _events(spark, sf, "user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"), cents("value").alias("cents"))
    return first_per_key(rows, ["user_id", "event_type", "hour"], ["ts", "event_id"]).groupBy("user_id").agg(F.sum("cents").alias("balance_cents"))


@query(f"SELECT user_id, cast(sum({CENTS}) AS bigint) AS balance_cents FROM events GROUP BY user_id")
def inbox_naive(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.sum(cents("value")).alias("balance_cents"))


@query(
    """SELECT event_type, count(*) AS attempts, count(DISTINCT (user_id, date_trunc('hour', ts))) AS effects, count(*) FILTER (WHERE event_id % 5 = 0) AS failed
    FROM events GROUP BY event_type"""
)
def delivery_audit(spark, sf):
    # Counted per message first, so distinct messages need no distinct count.
    per = load(spark, sf, "events").groupBy("event_type", "user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 5 == 0).alias("failed"))
    return per.groupBy("event_type").agg(F.sum("n").alias("attempts"), F.count("*").alias("effects"), F.sum("failed").alias("failed"))


@query("SELECT user_id, event_id AS winner FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1")
def first_claim_wins(spark, sf):
    rows = load(spark, sf, "events").where("event_type = 'purchase'")
    return rows.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("winner"))


@query(
    """SELECT event_id, row_number() OVER (PARTITION BY user_id, version ORDER BY ts, event_id) = 1 AS applied
    FROM (SELECT *, cast(json_extract_string(props, '$.k') AS bigint) // 10 AS version FROM events)"""
)
def version_cas(spark, sf):
    rows = _events(spark, sf, "user_id", F.floor(F.get_json_object("props", "$.k").cast("long") / 10).alias("version"))
    first = rows.groupBy("user_id", "version").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first"))
    return rows.join(first, ["user_id", "version"]).select("event_id", (F.col("event_id") == F.col("first")).alias("applied"))


@query(
    """SELECT event_id, token > coalesce(max(token) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted
    FROM (SELECT *, cast(json_extract_string(props, '$.k') AS bigint) AS token FROM events)"""
)
def fencing_accept(spark, sf):
    rows = _events(spark, sf, "user_id", F.get_json_object("props", "$.k").cast("long").alias("token"))
    before = F.max("token").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("event_id", (F.col("token") > F.coalesce(before, F.lit(0))).alias("accepted"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'click' ORDER BY ts, event_id LIMIT 100")
def outbox_drain(spark, sf):
    return _events(spark, sf, "event_type").where("event_type <> 'click'").orderBy("ts", "event_id").limit(100).select("event_id", "event_type")


@query(
    f"""SELECT account, cast(sum(cents) AS bigint) AS balance_cents FROM (SELECT user_id AS account, -{CENTS} AS cents FROM events
    UNION ALL SELECT cast(json_extract_string(props, '$.k') AS bigint), {CENTS} FROM events) GROUP BY account"""
)
def ledger_balance(spark, sf):
    amount = cents("value")
    both = F.array(F.struct(F.col("user_id").alias("account"), (-amount).alias("cents")), F.struct(F.get_json_object("props", "$.k").cast("long").alias("account"), amount.alias("cents")))
    return load(spark, sf, "events").select(F.inline(both)).groupBy("account").agg(F.sum("cents").alias("balance_cents"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN cast(7 AS bigint) END, cast(round(o_totalprice * 100) AS bigint) // 100) AS points FROM orders")
def backfill_points(spark, sf):
    have = F.when(F.col("o_orderkey") % 3 == 0, F.lit(7).cast("long"))
    return load(spark, sf, "orders").select("o_orderkey", F.coalesce(have, F.floor(cents("o_totalprice") / 100)).alias("points"))


@query("SELECT c_custkey, c_name, c_name AS display_name, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS shown FROM customer")
def expand_contract(spark, sf):
    """Files written before a column was added and files of both writers are read as one table, and the gaps filled."""
    path, rows = new_dir(spark, "expanding"), load(spark, sf, "customer").select("c_custkey", "c_name")
    old = rows.where("c_custkey % 2 <> 0")  # written by old code, without the new column
    new = rows.where("c_custkey % 2 = 0").withColumn("shown", F.upper("c_name"))  # written by new code, both columns
    old.write.parquet(f"{path}/writer=old")
    new.write.parquet(f"{path}/writer=new")
    expanded = spark.read.option("mergeSchema", "true").parquet(path)
    return expanded.select("c_custkey", "c_name", F.col("c_name").alias("display_name"), F.coalesce("shown", "c_name").alias("shown"))


@query("SELECT event_id, ts FROM events WHERE NOT (ts < timestamp '2024-01-10')")
def retention_delete(spark, sf):
    return load(spark, sf, "events").where("NOT (ts < timestamp_ntz'2024-01-10')").select("event_id", "ts")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 300) THEN 'X' ELSE o_orderstatus END AS status FROM orders"""
)
def bulk_reclassify(spark, sf):
    orders = load(spark, sf, "orders")
    first = orders.where("o_orderstatus = 'O'").orderBy("o_orderkey").limit(300).select("o_orderkey", F.lit("X").alias("new"))
    return orders.join(first, "o_orderkey", "left").select("o_orderkey", F.coalesce("new", "o_orderstatus").alias("status"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT (o_orderdate >= timestamp '1996-01-01' AND o_orderdate < timestamp '2001-01-01')")
def unmatched_partition(spark, sf):
    return unmatched(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1996-01-01", "2001-01-01")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def row_policy(spark, sf):
    return with_policy(load(spark, sf, "customer"), "c_nationkey", 7).select("c_custkey", "c_name")


def with_policy(frame: DataFrame, column: str, tenant: int | None) -> DataFrame:
    """Only the tenant's rows; without a tenant none."""
    return frame.where(F.col(column) == F.lit(tenant).cast(frame.schema[column].dataType))
