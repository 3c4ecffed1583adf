"""Sources and sinks as named queries: temporary views, tables made of queries, batches, logs, generated rows, metrics, the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein import functions as X
from skein.operators.registry import query
from skein.shared import new_dir
from skein.sources import logs
from skein.sources.tables import cents, load

CENTS = "cast(round(value * 100) AS bigint)"
TABLES = ["region", "nation", "customer", "orders"]


def _fresh(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey")
def temp_table(spark, sf):
    """A temporary view, read back by SQL."""
    name = _fresh("rich")
    load(spark, sf, "customer").where("c_acctbal > 5000").createOrReplaceTempView(name)
    return spark.sql(f"SELECT c_nationkey, count(*) AS n FROM {name} GROUP BY c_nationkey")


@query("SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey")
def create_table_as(spark, sf):
    """A table created from a query's rows, read back."""
    name, path = _fresh("per_customer"), new_dir(spark, "per-customer")
    load(spark, sf, "orders").createOrReplaceTempView(f"{name}_source")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}' AS SELECT o_custkey, count(*) AS n_orders FROM {name}_source GROUP BY o_custkey")
    return spark.table(name)


@query("SELECT count(*) AS n, cast(0 AS bigint) AS larger FROM events")
def batched_insert(spark, sf):
    """Rows written in files of at most 500; `larger` counts files above."""
    path = new_dir(spark, "batches")
    load(spark, sf, "events").write.option("maxRecordsPerFile", 500).parquet(path)
    per = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    return per.agg(F.sum("rows").alias("n"), F.count_if(F.col("rows") > 500).alias("larger"))


@query(
    """SELECT o AS order_id, cast('0x' || substr(md5('7|' || o), 1, 6) AS bigint) % 1500 AS customer_id, cast('0x' || substr(md5('7|' || o), 7, 6) AS bigint) % 100000 AS cents
    FROM (SELECT unnest(range(20000)) AS o)"""
)
def generated_orders(spark, sf):
    """Rows made in the tasks from their number and a seed, none held anywhere."""
    h = F.md5(F.concat(F.lit("7|"), F.col("id").cast("string")).cast("binary"))
    part = lambda at, most: F.conv(F.substring(h, at, 6), 16, 10).cast("long") % most
    return spark.range(20_000).select(F.col("id").alias("order_id"), part(1, 1500).alias("customer_id"), part(7, 100_000).alias("cents"))


@query(
    f"""SELECT 'events_total' || '{{event_type="' || event_type || '"}} ' || count(*) AS line FROM events GROUP BY event_type
    UNION ALL SELECT 'event_cents_bucket{{event_type="' || event_type || '",le="' || le || '"}} ' || count(*) FILTER (WHERE {CENTS} <= le * 100) FROM events, (SELECT unnest({X.HISTOGRAM_BOUNDS}) AS le) GROUP BY event_type, le
    UNION ALL SELECT 'event_cents_bucket{{event_type="' || event_type || '",le="+Inf"}} ' || count(*) FROM events GROUP BY event_type
    UNION ALL SELECT 'event_cents_sum{{event_type="' || event_type || '"}} ' || cast(sum({CENTS}) AS bigint) FROM events GROUP BY event_type"""
)
def metrics_text(spark, sf):
    """Counters and a cumulative histogram as lines of text, each label as name="value"; all counted in one pass."""
    kind, amount = F.col("event_type"), cents("value")
    counts = [F.count_if(amount <= b * 100).alias(f"b{b}") for b in X.HISTOGRAM_BOUNDS]
    per = load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(amount).alias("cents"), *counts)
    line = lambda name, n, **more: F.concat(F.lit(name), X.labels_text({"event_type": kind} | more), F.lit(" "), F.col(n).cast("string"))
    lines = [line("events_total", "n"), line("event_cents_sum", "cents"), line("event_cents_bucket", "n", le=F.lit("+Inf"))]
    lines += [line("event_cents_bucket", f"b{b}", le=F.lit(str(b))) for b in X.HISTOGRAM_BOUNDS]
    return per.select(F.explode(F.array(*lines)).alias("line"))


@query(
    """SELECT event_type AS route, count(*) AS lines, count(*) FILTER (WHERE event_type <> 'signup') AS parsed, cast(sum(CASE WHEN event_type <> 'signup' THEN event_id END) AS bigint) AS total
    FROM events GROUP BY event_type"""
)
def text_log(spark, sf):
    """Lines of three formats, and some of none, written as text files and parsed from them."""
    path = new_dir(spark, "text-log")
    line = F.expr(
        """CASE event_type WHEN 'click' THEN 'took ' || event_id || ' for click' WHEN 'view' THEN 'view ms=' || event_id WHEN 'error' THEN 'error after ' || event_id || ' ms'
        WHEN 'purchase' THEN 'took ' || event_id || ' for purchase' ELSE event_type || ' finished' END"""
    )
    load(spark, sf, "events").select(line.alias("value")).write.text(path)
    value = F.col("value")
    took = logs.field_in_text(value, [r"^took (\d+) for ", r" ms=(\d+)$", r" after (\d+) ms$"]).cast("long")
    route = logs.field_in_text(value, [r" for (\w+)$", r"^(\w+) "])
    rows = logs.read_text(spark, path).select(route.alias("route"), took.alias("took"))
    return rows.groupBy("route").agg(F.count("*").alias("lines"), F.count("took").alias("parsed"), F.sum("took").alias("total"))


@query(
    f"""SELECT event_type AS route, count(*) AS lines, count(*) FILTER (WHERE user_id % 10 = 0) AS broken, cast(sum(CASE WHEN user_id % 10 <> 0 THEN {CENTS} END) AS bigint) AS cents FROM events GROUP BY event_type"""
)
def ndjson_log(spark, sf):
    """One object per line, some lines cut off, written as text files and read as JSON; a broken line keeps its text."""
    path = new_dir(spark, "ndjson-log")
    whole = F.to_json(F.struct(F.col("event_id").cast("string").alias("requestId"), F.col("event_type").alias("route"), (F.col("value")).alias("durationMs")))
    line = F.when(F.col("user_id") % 10 == 0, F.concat(F.col("event_type"), F.lit(" "), F.substring(whole, 1, 20))).otherwise(whole)
    load(spark, sf, "events").select(line.alias("value")).write.text(path)
    rows = logs.read_ndjson(spark, path).select("route", "durationMs", "_corrupt_record")
    broken = F.col("_corrupt_record")
    route = F.coalesce("route", F.substring_index(broken, " ", 1))
    return rows.groupBy(route.alias("route")).agg(F.count("*").alias("lines"), F.count(broken).alias("broken"), F.sum(cents("durationMs")).alias("cents"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def array_batches(spark, sf):
    """Parameters of a batch as arrays of equal length, one batch per nation and segment, zipped back into rows."""
    per = load(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.collect_list(F.struct("c_custkey", "c_name")).alias("rows"))
    arrays = per.select("c_mktsegment", F.col("rows.c_custkey").alias("keys"), F.col("rows.c_name").alias("names"))
    zipped = arrays.select("c_mktsegment", F.inline(F.arrays_zip("keys", "names")))
    return zipped.select(F.col("keys").alias("c_custkey"), F.col("names").alias("c_name"), "c_mktsegment")


@query(
    """SELECT t.table_name, c.column_name, cast(c.ordinal_position AS bigint) AS position, count(*) OVER (PARTITION BY t.table_name) AS n_columns FROM information_schema.tables t
    JOIN information_schema.columns c ON c.table_name = t.table_name WHERE t.table_name IN ('region', 'nation', 'customer', 'orders')"""
)
def catalog_join(spark, sf):
    """Tables, their columns and the number of columns of each, from three listings of what the files declare."""
    schemas = {t: load(spark, sf, t).schema for t in TABLES}
    tables = spark.createDataFrame([(i, t) for i, t in enumerate(TABLES)], "table_id long, table_name string")
    columns = spark.createDataFrame([(i, f.name, k + 1) for i, t in enumerate(TABLES) for k, f in enumerate(schemas[t].fields)], "table_id long, column_name string, position long")
    sizes = columns.groupBy("table_id").agg(F.count("*").alias("n_columns"))
    return tables.join(columns, "table_id").join(sizes, "table_id").select("table_name", "column_name", "position", "n_columns")


@query("SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders ORDER BY priority DESC NULLS LAST, o_orderkey LIMIT 50")
def nulls_last(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"))
    return rows.orderBy(F.col("priority").desc_nulls_last(), "o_orderkey").limit(50)


@query("SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders ORDER BY priority NULLS FIRST, o_orderkey LIMIT 50")
def nulls_first(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"))
    return rows.orderBy(F.col("priority").asc_nulls_first(), "o_orderkey").limit(50)


@query(
    """SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id
    FROM (SELECT event_id, md5(event_id || '|' || event_type) AS h FROM events)"""
)
def uuid_default(spark, sf):
    """Keys of rows as UUIDs that every run gives again."""
    return load(spark, sf, "events").select("event_id", X.uuid_of("event_id", "event_type").alias("id"))


@query("SELECT c_custkey, 270 + cast('0x' || substr(md5(cast(c_custkey AS varchar)), 1, 8) AS bigint) % 61 AS ttl_seconds FROM customer")
def jittered_ttl(spark, sf):
    """Five minutes, give or take thirty seconds."""
    return load(spark, sf, "customer").select("c_custkey", X.jittered(300, 30, "c_custkey").alias("ttl_seconds"))


@query()
def hashed_lock_key(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", X.keyed_hash("c_name").alias("lock_key"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def tenant_function(spark, sf):
    """A row policy by a scalar SQL function."""
    name = _fresh("current_tenant")
    spark.sql(f"CREATE TEMPORARY FUNCTION {name}() RETURNS INT RETURN 7")
    load(spark, sf, "customer").createOrReplaceTempView(f"{name}_rows")
    return spark.sql(f"SELECT c_custkey, c_name FROM {name}_rows WHERE c_nationkey = {name}()")


@query(
    """WITH own AS (SELECT cast(o_orderkey AS bigint) AS order_id, o_orderstatus AS status FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders))
    SELECT * FROM (SELECT * FROM own UNION ALL SELECT cast(0 AS bigint), 'none' WHERE NOT EXISTS (SELECT 1 FROM own)) ORDER BY order_id LIMIT 1"""
)
def union_all_found(spark, sf):
    """A customer with orders: the fallback row isn't given."""
    orders = load(spark, sf, "orders")
    first = orders.agg(F.min("o_custkey")).first()[0]
    own = orders.where(F.col("o_custkey") == F.lit(first)).select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status")).orderBy("order_id").limit(1)
    other = spark.sql("SELECT 0L AS order_id, 'none' AS status")
    return own.unionByName(other.join(own.select(F.lit(1).alias("one")), F.lit(True), "left_anti")).limit(1)
