"""Ordered folds against plain loops, and their figures for bursts."""

import random

from pyspark.sql import functions as F

from skein.operators import catalog, folds

SF = "/root/testdata/sf0.001"


def burst(spark, n, step, added):
    rows = spark.range(n).selectExpr("id AS event_id", "1L AS key", "0L AS at")
    return folds.fold(rows, "key", ["at", "event_id"], lambda: None, step, ["at"], added)


def test_bursts_admit_what_the_capacity_allows(spark):
    assert burst(spark, 120, folds.token_bucket(100, 1.0), "allowed boolean, tokens double").where("allowed").count() == 100
    assert burst(spark, 120, folds.sliding_log(100, 1_000_000), "allowed boolean").where("allowed").count() == 100


def events(spark):
    found = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "user_id", "event_type", "unix_micros(cast(ts AS timestamp)) AS at").collect()
    return sorted(found, key=lambda r: (r["user_id"], r["at"], r["event_id"]))


def test_sliding_limiter_equals_a_loop(spark):
    admitted, expected = {}, {}
    for r in events(spark):
        own = admitted.setdefault(r["user_id"], [])
        expected[r["event_id"]] = sum(t > r["at"] - 21_600_000_000 for t in own) < 2
        if expected[r["event_id"]]:
            own.append(r["at"])
    assert {r["event_id"]: r["allowed"] for r in catalog.queries()["sliding_limiter"](spark, SF).collect()} == expected


def test_breaker_equals_a_loop(spark):
    state, expected = {}, {}
    for r in events(spark):
        open_since, failures = state.get(r["user_id"], (None, 0))
        if open_since is not None and r["at"] - open_since < 43_200_000_000:
            expected[r["event_id"]] = (False, "OPEN")
            continue
        if r["event_type"] != "error":
            open_since, failures = None, 0
        elif open_since is not None or failures + 1 >= 2:
            open_since, failures = r["at"], 2
        else:
            failures += 1
        state[r["user_id"]] = (open_since, failures)
        expected[r["event_id"]] = (True, "CLOSED" if open_since is None else "OPEN")
    got = catalog.queries()["breaker_fold"](spark, SF).collect()
    assert {r["event_id"]: (r["ran"], r["breaker_state"]) for r in got} == expected


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, None, 0), (3, 7, 0)], "event_id long, key long, at long")
    got = folds.fold(rows, "key", ["at", "event_id"], lambda: None, folds.sliding_log(1, 10), ["at"], "allowed boolean")
    assert {r["event_id"]: r["allowed"] for r in got.collect()} == {1: True, 2: False, 3: True}
    assert folds.fold(rows.limit(0), "key", ["at"], lambda: None, folds.sliding_log(1, 10), ["at"], "allowed boolean").count() == 0


def test_bounded_counter_equals_a_loop(spark):
    pending, expected = {}, {}
    for r in events(spark):
        n = pending.get(r["user_id"], 0)
        release = r["event_type"] == "purchase"
        pending[r["user_id"]] = max(0, n - 1) if release else min(5, n + 1)
        expected[r["event_id"]] = (not release and n < 5, pending[r["user_id"]])
    got = catalog.queries()["bounded_admission"](spark, SF).collect()
    assert {r["event_id"]: (r["admitted"], r["pending"]) for r in got} == expected


def test_a_hot_counter_is_cut_into_parts(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([-1, 1, 1])) for k in ("hot", "cold", None) for i in range(600 if k == "hot" else 5)]
    frame = spark.createDataFrame(rows, "k string, at long, d long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["at"]): r["n"] for r in folds.clamped(frame, "k", ["at"], F.col("d"), 0, 4, "n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    now, expected = {}, {}
    for k, at, d in rows:
        now[k] = min(max(now.get(k, 0) + d, 0), 4)
        expected[k, at] = now[k]
    assert got == expected


def test_token_bucket_refills(spark):
    """Capacity 2, a token each second: two at once, none left, one after a second, full after ten."""
    rows = spark.createDataFrame([(i, "k", t) for i, t in enumerate((0, 0, 0, 1_000_000, 1_500_000, 11_500_000, 11_500_000, 11_500_000))], "event_id long, key string, at long")
    out = folds.fold(rows, "key", ["at", "event_id"], lambda: None, folds.token_bucket(2, 1.0), ["at"], "allowed boolean, tokens double")
    got = [(r["allowed"], r["tokens"]) for r in sorted(out.collect(), key=lambda r: r["event_id"])]
    assert got == [(True, 1.0), (True, 0.0), (False, 0.0), (True, 0.0), (False, 0.5), (True, 1.0), (True, 0.0), (False, 0.0)]


def test_breaker_is_half_open_once(spark):
    minute = 60_000_000
    rows = [(0, True), (1, True), (2, False), (62, True), (63, False), (123, False), (124, True)]
    frame = spark.createDataFrame([(i, "k", m * minute, failed) for i, (m, failed) in enumerate(rows)], "event_id long, key string, at long, failed boolean")
    out = folds.fold(frame, "key", ["at"], lambda: None, folds.breaker(2, 60 * minute), ["at", "failed"], "ran boolean, found string, breaker_state string")
    got = [(r["ran"], r["found"], r["breaker_state"]) for r in sorted(out.collect(), key=lambda r: r["event_id"])]
    assert got == [
        (True, "CLOSED", "CLOSED"), (True, "CLOSED", "OPEN"), (False, "OPEN", "OPEN"), (True, "HALF_OPEN", "OPEN"),
        (False, "OPEN", "OPEN"), (True, "HALF_OPEN", "CLOSED"), (True, "CLOSED", "CLOSED"),
    ]


def test_a_hold_ends(spark):
    rows = [(0, 1, False, 0), (1, 2, True, 1), (2, 2, False, 5), (3, 2, False, 10), (4, 1, True, 12), (5, 2, True, 15), (6, 3, False, 99)]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "event_id long, user_id long, sells boolean, at long, seat string")
    out = folds.fold(frame, "seat", ["at"], lambda: None, folds.seats(10), ["user_id", "sells", "at"], "outcome string, holder long, until long")
    assert [r["outcome"] for r in sorted(out.collect(), key=lambda r: r["event_id"])] == ["held", "refused", "refused", "held", "refused", "sold", "refused"]
