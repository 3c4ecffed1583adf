"""Queries whose results stand for all rows of their tables."""

from collections import defaultdict

from skein.operators import catalog
from skein.sources.tables import load

SF = "/root/testdata/sf0.001"


def test_blocked_edges_reach_over_all_days(spark):
    events = load(spark, SF, "events").selectExpr("event_id", "user_id", "event_type", "to_date(ts) AS day", "CASE WHEN event_id % 7 <> 0 THEN get_json_object(props, '$.k') END AS k").collect()
    holders = defaultdict(list)
    for r in events:
        if r["event_type"] == "purchase":
            holders[r["user_id"], r["k"]].append(r["event_id"])
    expected = sorted((r["event_id"], h) for r in events if r["event_type"] == "error" for h in holders[r["user_id"], r["k"]])
    got = sorted(tuple(r) for r in catalog.queries()["blocked_edges"](spark, SF).collect())
    assert got == expected
    day = {r["event_id"]: r["day"] for r in events}
    assert len({day[w] for w, _ in got}) > 2


def test_spend_rank_ranks_customers_by_revenue(spark):
    lines, orders = (load(spark, SF, t).collect() for t in ("lineitem", "orders"))
    owner, cents = {r["o_orderkey"]: r["o_custkey"] for r in orders}, defaultdict(int)
    for r in lines:
        cents[owner[r["l_orderkey"]]] += round(r["l_extendedprice"] * 100)
    got = {r["c_custkey"]: (r["revenue_cents"], r["place"]) for r in catalog.queries()["spend_rank"](spark, SF).collect()}
    assert len(got) > 25
    assert got == {c: (n, 1 + sum(m > n for m in cents.values())) for c, n in cents.items()}
    top = catalog.queries()["fanout_fixed"](spark, SF).collect()
    assert [(r["c_custkey"], r["revenue_cents"]) for r in top] == sorted(((c, n) for c, (n, place) in got.items() if place <= 10), key=lambda x: (-x[1], x[0]))[:10]


def test_two_cycles_are_between_whole_ids(spark):
    rows = load(spark, SF, "events").selectExpr("user_id", "cast(get_json_object(props, '$.k') AS long) AS k").collect()
    edges = {(r["user_id"], r["k"]) for r in rows}
    got = sorted(tuple(r) for r in catalog.queries()["two_cycle_whole"](spark, SF).collect())
    assert got == sorted((a, b) for a, b in edges if a < b and (b, a) in edges)


def test_insert_ignore_meets_stored_rows(spark):
    events = load(spark, SF, "events").selectExpr("user_id", "event_id", "ts", "ts < timestamp_ntz '2024-01-03' AS early").collect()
    stored = {r["user_id"] for r in events if r["early"]}
    assert stored & {r["user_id"] for r in events if not r["early"]}
    got = {r["user_id"]: r["event_id"] for r in catalog.queries()["insert_ignore_stored"](spark, SF).collect()}
    first = {}
    for r in sorted(events, key=lambda r: (not r["early"], r["ts"], r["event_id"])):
        first.setdefault(r["user_id"], r["event_id"])
    assert got == first
