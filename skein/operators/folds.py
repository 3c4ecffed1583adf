"""Ordered per-key state machines: rows of a key in order, one state carried along.

Rows are dealt by key and sorted within partitions; a partition is streamed in Arrow batches and only the
current key's state is held, so a key with very many rows needs no more memory than others.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.shared import settle


def fold(frame: DataFrame, key: str | list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple], inputs: list[str], added: str) -> DataFrame:
    """Adds the columns `added` (a DDL list): step(state, values of `inputs`) gives the next state and a row's new values.

    `order` must be total within a key. Rows with a null key form a key of their own.
    """
    key_columns = [key] if isinstance(key, str) else key
    names = [x.split()[0] for x in added.split(", ")]
    base = frame.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", " + added

    def run(batches):
        current, state, begun = None, None, False
        for batch in batches:
            keys = [tuple(None if k != k else k for k in row) for row in zip(*(batch[c].tolist() for c in key_columns))]
            rows = []
            for k, values in zip(keys, batch[inputs].itertuples(index=False, name=None)):
                if not begun or k != current:
                    current, state, begun = k, start(), True
                state, new = step(state, values)
                rows.append(new)
            for name, column in zip(names, zip(*rows) if rows else [[] for _ in names]):
                batch[name] = list(column)
            yield batch

    return base.repartition(*key_columns).sortWithinPartitions(*key_columns, *order).mapInPandas(run, schema)


def token_bucket(capacity: float, per_second: float, cost: float = 1.0) -> Callable:
    """(allowed, tokens): a bucket that refills with time; the state moves on even when a request is refused."""

    def step(state, values):
        now = values[0]
        tokens, last = state or (capacity, now)
        tokens = min(capacity, tokens + max(0, now - last) / 1e6 * per_second)
        allowed = tokens >= cost
        tokens -= cost if allowed else 0
        return (tokens, now), (allowed, tokens)

    return step


def sliding_log(limit: int, window_micros: int) -> Callable:
    """(allowed,): admits while fewer than `limit` admitted requests are younger than the window."""

    def step(state, values):
        now, admitted = values[0], state if state is not None else deque()
        while admitted and admitted[0] <= now - window_micros:
            admitted.popleft()
        allowed = len(admitted) < limit
        if allowed:
            admitted.append(now)
        return admitted, (allowed,)

    return step


def breaker(threshold: int, cooldown_micros: int) -> Callable:
    """(ran, found, breaker_state): consecutive failures open it; after the cooldown a call finds it half open and tries whether it closes.

    `found` is the state in which the call found the breaker, `breaker_state` the one in which it left it.
    """

    def step(state, values):
        now, failed = values
        name, failures, opened = state or ("CLOSED", 0, 0)
        if name == "OPEN" and now - opened >= cooldown_micros:
            name = "HALF_OPEN"
        if name == "OPEN":
            return (name, failures, opened), (False, name, name)
        if not failed:
            after = ("CLOSED", 0, opened)
        elif name == "HALF_OPEN" or failures + 1 >= threshold:
            after = ("OPEN", failures + (name != "HALF_OPEN"), now)
        else:
            after = ("CLOSED", failures + 1, opened)
        return after, (True, name, after[0])

    return step


def seats(hold_micros: int) -> Callable:
    """(outcome, holder, until): a seat is held by a user until a time, and sold to that user before it. An expired hold frees the seat."""

    def step(state, values):
        user, sells, now = values
        holder, until, sold = state or (None, 0, False)
        held = holder is not None and until > now
        if sells:
            done = held and holder == user and not sold
            state = (holder, until, sold or done)
            outcome = "sold" if done else "refused"
        else:
            done = not sold and not held
            state = (user, now + hold_micros, False) if done else (holder, until, sold)
            outcome = "held" if done else "refused"
        return state, (outcome, state[0], state[1])

    return step


def clamped(frame: DataFrame, key: str, order: list[str], delta: Column, low: int, high: int, out: str) -> DataFrame:
    """Adds `out`, a per-key counter after each row: the counter before plus `delta`, kept within low and high; it starts at low.

    Steps of such a counter compose to x -> min(max(x + a, b), c), so a key of very many rows is cut into parts: each
    part's rows are composed to one step, the few steps of a key are applied in order, and each part starts from there.
    """
    rows = frame.withColumn("_delta", delta.cast("long")).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    laid = settle(rows.withColumn("_part", F.spark_partition_id()))
    kind = frame.schema[key].dataType.simpleString()

    def compose(state, values):
        d = values[0]
        a, b, c = state or (0, low, high)
        return (a + d, min(max(b + d, low), high), min(max(c + d, low), high)), ()

    def summed(batches):
        import pandas as pd

        found: dict = {}
        for batch in batches:
            for part, k, d in zip(batch["_part"].tolist(), batch[key].tolist(), batch["_delta"].tolist()):
                own = part, None if k != k else k
                found[own], _ = compose(found.get(own), (d,))
            while len(found) > 1:  # rows come sorted by key: all but the last are whole
                own = next(iter(found))
                yield pd.DataFrame([(own[0], own[1], *found.pop(own))], columns=["_part", key, "_a", "_b", "_c"]).astype({key: object})
        if found:
            yield pd.DataFrame([(own[0], own[1], *step) for own, step in found.items()], columns=["_part", key, "_a", "_b", "_c"]).astype({key: object})

    steps = laid.select("_part", key, "_delta").mapInPandas(summed, f"_part int, `{key}` {kind}, _a long, _b long, _c long")

    def apply(state, values):
        a, b, c = values
        now = low if state is None else state
        return min(max(now + a, b), c), (now,)

    starts = fold(steps, key, ["_part"], lambda: None, apply, ["_a", "_b", "_c"], "_start long")
    starts = starts.select(F.col("_part").alias("_of"), F.col(key).alias("_key"), "_start")
    begun = laid.join(starts, (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))

    def walk(state, values):
        d, start = values
        now = min(max((start if state is None else state) + d, low), high)
        return now, (now,)

    done = fold(begun, ["_part", key], order, lambda: None, walk, ["_delta", "_start"], f"{out} long")
    return done.select(*frame.columns, out)
