"""Mixing: targets and taken words against plain programs, in any layout, with hot and tiny sources."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import mixing

SF = "/root/testdata/sf0.001"
SOLID = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes):
    """source -> target by filling up round after round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = mixing.SHARE * sum(sizes.values()), set(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / whole > mixing.LIMIT * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in above:
            out[s] = mixing.LIMIT * sizes[s]
        left -= sum(out[s] for s in above)
        open_ -= set(above)
    return out


def plain(rows):
    """Sorted (doc_id, size, source_size, target, taken); rows are (doc_id, text, source)."""
    entries = Counter((r[0], r[1] or "", r[2]) for r in rows)
    size = {e: len(SOLID.findall(e[1])) for e in entries}
    per = defaultdict(int)
    for e, n in entries.items():
        per[e[2]] += n * size[e]
    target = plain_targets(per)
    out = []
    for source in per:
        own = sorted((e for e in entries if e[2] == source), key=lambda e: (hashlib.md5(f"{'' if e[0] is None else e[0]}|{e[1]}".encode()).hexdigest(), e[0] or 0))
        start = 0
        for e in own:
            n = entries[e]
            taken = sum(max(0, min(start + k * per[source] + n * size[e], int(target[source])) - (start + k * per[source])) for k in range(2))
            out += [(str(e[0]), size[e], per[source], round(target[source], 6), taken // n + (i < taken % n)) for i in range(n)]
            start += n * size[e]
    return sorted(out)


def got(frame):
    return sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.report(frame).collect())


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, "w " * (i * 7 % 50), f"s{i % 5}" if i % 7 else None) for i in range(120)]
    rows += [(3, "w " * 21, "s3")] * 40 + [(3, "other text", "s3"), (None, "no id", "s1"), (None, "no id", "s1"), (None, None, None), (900, None, "s1"), (901, "", "empty")]
    rows += [(902, "x " * 30_000, "long"), (903, "one", "tiny")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_equals_a_plain_program(spark, awkward):
    assert got(awkward[0].repartition(3)) == plain(awkward[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(docs) == plain([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])


def test_no_result_depends_on_the_layout(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame in (docs, awkward[0]):
        assert got(frame) == got(frame.repartition(7, "source", "doc_id")) == got(frame.coalesce(1))
    kept = [sorted(str(r["doc_id"]) for r in mixing.mixed(x).collect()) for x in (docs, docs.repartition(7, "lang"))]
    assert kept[0] == kept[1]


def test_block_size_changes_no_target(awkward):
    rows = [sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.mix(mixing.entries(awkward[0]), block_words=b).collect()) for b in (7, 1024)]
    assert rows[0] == rows[1]


def test_mixed_rows(awkward):
    frame, rows = awkward
    more = frame.select("*", *[F.lit(1).alias(c) for c in ("size", "copies", "order", "copy", "rank", "taken", "_x")])
    mixed = mixing.mixed(more)
    assert mixed.columns == more.columns
    each = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    n = Counter(rows)
    for row in n:
        size = len(SOLID.findall(row[1] or ""))
        assert each[row] % n[row] == 0 and each[row] <= 2 * n[row]
        if size == 0:
            assert each[row] == n[row]
    assert mixing.report(frame.limit(0)).count() == mixing.mixed(frame.limit(0)).count() == 0


def test_a_hot_row_is_dealt_out(spark):
    rows = spark.range(2).select(F.col("id"), F.lit(35_000).cast("long").alias("n"))
    from skein.llm._work import each_copy

    copies = each_copy(rows, "n", "copy")
    assert copies.count() == 70_000 and copies.distinct().count() == 70_000
    assert copies.agg(F.max("copy")).first()[0] == 34_999
