"""Near-duplicates: tiles in any size, links against all pairs, and rows with null or clashing ids."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import components, simhash

SF = "/root/testdata/sf0.001"


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_forest_connects_what_all_pairs_connect():
    rng = random.Random(4)
    for n in (0, 1, 2, 300):
        seeds = [rng.getrandbits(64) for _ in range(n // 10 + 1)]
        x = [rng.choice(seeds) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & ((1 << 64) - 1) for _ in range(n)]
        y = x[: n // 2] + [rng.getrandbits(64) for _ in range(n // 3)]
        expected = groups([(a, b) for a in x for b in y if (a ^ b).bit_count() <= 3], {*x, *y})
        found = simhash.forest(np.array(x, np.uint64), np.array(y, np.uint64), 3)
        assert groups([tuple(map(int, p)) for p in found], {*x, *y}) == expected


def test_a_tile_of_near_copies_is_one_component():
    x = np.array([1 << a | 1 << b for a, b in combinations(range(64), 2)], np.uint64)
    assert len(simhash.forest(x, x, 3)) == len(x) - 1


def test_cut_tiles_give_the_same_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [sorted(tuple(r) for r in simhash.near_duplicates(docs, tile_rows=n).collect()) for n in (2, simhash.TILE_ROWS)]
    assert got[0] == got[1]
    assert len({r[2] for r in got[0]}) < len(got[0])


def test_many_parts_and_few(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(20)]
    values = sorted({b ^ 1 << rng.randrange(40) for b in base for _ in range(30)})
    frame = spark.createDataFrame([(v,) for v in values], "fp long").repartition(4)
    found = components.components(simhash.links(frame)).collect()
    expected = groups([(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 3], values)
    got = {v: v for v in values} | {r["node"]: r["root"] for r in found}
    assert {frozenset(v for v in values if got[v] == r) for r in got.values()} == {frozenset(v for v in values if expected[v] == r) for r in expected.values()}


WORDS = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize("tile_rows", [1, simhash.TILE_ROWS])
def test_kept_rows_are_decided_row_by_row(spark, tile_rows):
    other = " ".join(f"x{i * i}" for i in range(60))
    rows = [(1, WORDS, "a"), (1, other, "b"), (2, WORDS, "c"), (2, other + " y1 y2 y3 y4 y5 y6 y7 y8 y9 " * 9, "d"), (5, WORDS, "e"), (5, WORDS, "e"), (None, other, "f"), (None, "lone text of null", "g"), (None, "lone text of null", "g")]
    rows += [(7, None, "h"), (8, "", "i"), (6, " \n", "j")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    more = frame.select("*", *[F.lit(1).alias(c) for c in ("_fp", "key", "least", "root", "component_id")])
    kept = simhash.keep_one(more, tile_rows=tile_rows)
    assert kept.columns == more.columns
    assert sorted((str(r["doc_id"]), r["fp"]) for r in kept.collect()) == [("1", "a"), ("1", "b"), ("2", "d"), ("6", "j"), ("None", "g")]
    assert simhash.keep_one(frame.limit(0)).count() == 0


def test_null_ids_name_no_component(spark):
    frame = spark.createDataFrame([(None, WORDS), (4, WORDS), (3, WORDS), (None, "something else"), (9, "x")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(frame).collect())
    assert got == [("3", "3"), ("4", "3"), ("9", "9"), ("None", "3"), ("None", "None")]
