"""Paging, constraints, layout, policy and plan shape."""

import pytest
from pyspark.sql import functions as F

from skein import functions as X
from skein import plans
from skein.functions import running
from skein.operators import catalog, evolve, layouts
from skein.sources import layout, logs
from skein.sources.tables import load

SF = "/root/testdata/sf0.001"


def test_keyset_pages_cover_every_row_once(spark):
    events = load(spark, SF, "events").select("event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
    seen, cursor = [], None
    while True:
        page = events if cursor is None else events.where(X.keyset_after([("ts", "timestamp_ntz", cursor[0]), ("event_id", "long", cursor[1])]))
        page = page.orderBy("ts", "event_id").limit(300).collect()
        if not page:
            break
        seen += [r["event_id"] for r in page]
        cursor = (str(page[-1]["ts"]), page[-1]["event_id"])
    assert len(seen) == len(set(seen)) == events.count()


def test_month_rewrite_is_pushed_down_and_equal(spark):
    queries = catalog.queries()
    fast, slow = queries["month_range_filter"](spark, SF), queries["month_trunc_filter"](spark, SF)
    assert sorted(fast.collect()) == sorted(slow.collect())
    assert "GreaterThanOrEqual(o_orderdate" in plans.pushed_filters(fast)[0]
    assert "GreaterThanOrEqual(o_orderdate" not in "".join(plans.pushed_filters(slow))


def test_constraints_tell_violations(spark):
    frame = spark.createDataFrame([(1, 5), (1, 5), (None, 3), (None, 3), (2, None), (3, -1)], "id long, amount long")
    found = [r["constraint"] for r in evolve.violations(frame, ["id"], ["id"], "amount >= 0").collect()]
    assert sorted(found) == ["check amount >= 0", "not null id", "not null id", "unique id"]
    parents = spark.createDataFrame([(1,), (2,)], "key long")
    assert [r["id"] for r in evolve.orphans(frame, parents, "id", "key").collect()] == [3]


def test_first_write_wins_over_existing_rows(spark):
    existing = spark.createDataFrame([(1, 0, "old")], "k long, at long, v string")
    incoming = spark.createDataFrame([(1, 1, "x"), (2, 3, "late"), (2, 2, "early")], "k long, at long, v string")
    assert sorted(tuple(r) for r in evolve.insert_missing(existing, incoming, ["k"], ["at"]).collect()) == [(1, 0, "old"), (2, 2, "early")]


def test_partitioned_layout(spark, tmp_path):
    path = str(tmp_path / "by_type")
    events = load(spark, SF, "events")
    layout.write_partitioned(events, path, layout.by_list("event_type", ["click", "view"]), "part")
    assert layout.partitions(spark, path) == ["part=__default__", "part=click", "part=view"]
    clicks = spark.read.parquet(path).where("part = 'click'")
    assert clicks.count() == events.where("event_type = 'click'").count()
    assert "part" in plans.partition_filters(clicks)[0]
    assert layout.reconcile(spark, path, "part", ["click", "view", "x"]) == {"missing": ["x"], "unexpected": ["__default__"]}
    assert layout.drop_partition(spark, path, "part", "click") and not layout.drop_partition(spark, path, "part", "click")


def test_policy_denies_by_default(spark):
    customer = load(spark, SF, "customer")
    assert evolve.with_policy(customer, "c_nationkey", None).count() == 0
    assert evolve.with_policy(customer, "c_nationkey", 7).where("c_nationkey <> 7").count() == 0


def test_three_percentiles_differ_where_they_should(spark):
    frame = spark.range(1, 11).selectExpr("1 AS k", "id AS v", "id").unionByName(spark.createDataFrame([(2, None, 11), (None, 5, 12)], "k int, v long, id long"))
    got = {r["k"]: r for r in running.percentiles(frame, ["k"], "v", {"near": running.nearest(0.5), "floor": running.floor_rank(0.5)}).collect()}
    assert (got[1]["near"], got[1]["floor"], got[1]["n"], got[1]["least"], got[1]["most"]) == (5, 6, 10, 1, 10)
    assert got[None]["near"] == 5 and 2 not in got
    one = frame.where("k = 1")
    assert one.agg(X.nearest_rank(0.5, "v")).first()[0] == 5 and one.agg(F.median("v")).first()[0] == 5.5


def test_running_sums_over_many_parts(spark):
    rows = [(k, i, i % 5) for k in (None, "a", "hot") for i in range(400 if k == "hot" else 7)]
    frame = spark.createDataFrame(rows, "k string, at long, n long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["at"]): r["before"] for r in running.running(frame, ["k"], ["at"], {"before": F.col("n")}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(k, i): sum(n for q, j, n in rows if q == k and j < i) for k, i, _ in rows}
    assert running.running(frame.limit(0), [], ["at"], {"before": F.col("n")}).count() == 0


@pytest.mark.parametrize("name, months", [("pruned_week", 1), ("pruned_boundary", 2), ("pruned_year", 12)])
def test_layouts_are_pruned(spark, name, months):
    frame = catalog.queries()[name](spark, SF)
    assert "month" in plans.partition_filters(frame)[0]
    path = layouts.orders_by_month(spark, SF)
    low, high = {"pruned_week": ("1997-06-09", "1997-06-16"), "pruned_boundary": ("1997-06-28", "1997-07-05"), "pruned_year": ("1997-01-01", "1998-01-01")}[name]
    read = spark.read.parquet(path).where(layout.between("o_orderdate", "month", low, high))
    assert len({f.split("month=")[1][:7] for f in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) <= months
    assert len(layout.partitions(spark, path)) > 12


def test_keyed_hash_is_xxh64(spark):
    xxhash = pytest.importorskip("xxhash")
    for r in catalog.queries()["hashed_lock_key"](spark, SF).join(load(spark, SF, "customer"), "c_custkey").limit(50).collect():
        assert r["lock_key"] % (1 << 64) == xxhash.xxh64_intdigest(r["c_name"].encode(), seed=42)


def test_labels_are_escaped(spark):
    got = spark.range(1).select(X.labels_text({"a": F.lit('x"y\\z\nw'), "b": F.lit(3)}).alias("t")).first()["t"]
    assert got == '{a="x\\"y\\\\z\\nw",b="3"}'


def test_logs_keep_broken_lines(spark, tmp_path):
    file = tmp_path / "log.ndjson"
    file.write_text('{"route": "/orders", "durationMs": 2.5}\nnot json\n')
    rows = logs.read_ndjson(spark, str(file)).collect()
    assert sorted(str(r["_corrupt_record"]) for r in rows) == ["None", "not json"]


@pytest.mark.parametrize("name", ["fanout_fixed", "customer_revenue", "keyset_page", "route_rollup"])
def test_scans_read_few_columns_and_no_cartesian_product(spark, name):
    frame = catalog.queries()[name](spark, SF)
    assert all(len(c) <= 4 for c in plans.read_columns(frame))
    assert plans.count_nodes(frame, "CartesianProduct") == 0
