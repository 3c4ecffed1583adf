"""Decontamination in several passes, with awkward items, and from another folder."""

import hashlib
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted((str(r["doc_id"]), r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in frame.collect())


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")]


def test_several_blocks_give_what_one_gives(tables):
    docs, benchmark = tables
    one = rows(decontaminate.find_contamination(docs, benchmark))
    several = decontaminate.find_contamination(docs, benchmark, block_words=300)
    assert len(decontaminate.write_blocks(benchmark, "item_id", "text", 300)[1]) > 2
    assert rows(several) == one
    assert any(items for *_, items in one)


def test_a_pass_is_alone_in_its_plan(tables):
    from skein import plans

    docs, benchmark = tables
    assert plans.count_nodes(decontaminate.find_contamination(docs, benchmark, block_words=300), "MapInArrow") == 1


def test_awkward_items(spark):
    a = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12 a13 a14"
    items = [(None, "lone words"), ("", "other words"), ("x", None), ("y", " \n"), ("z", a.replace(" ", "\t")), ("z", "second text"), ("z", "second text"), ("w", a.upper())]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, "Lone-words"), (2, "OTHER words; lone words"), (3, "second text " + a), (3, "second text " + a), (4, None), (5, ""), (6, "one " * 50_000 + a), (None, a[:-4])], "doc_id long, text string")
    clashing = docs.select("*", *[F.lit(0).alias(c) for c in ("n_words", "spans", "items", "item", "block", "rank")])
    for block_words in (decontaminate.BLOCK_WORDS, 5):
        found = decontaminate.find_contamination(clashing, benchmark, block_words=block_words)
        got = {r["doc_id"]: (r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in found.collect()}
        assert got[1] == (2, [(0, 1)], [None])
        assert got[2] == (4, [(0, 3)], [None, ""])
        assert got[3] == (16, [(0, 15)], ["w", "z"])
        assert got[4] == got[5] == (0, [], [])
        assert got[6] == (50_014, [(50_000, 50_013)], ["w", "z"])
        assert got[None] == (13, [(0, 12)], ["w", "z"])
        assert found.count() == docs.count()
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).where("size(spans) > 0 or size(items) > 0").count() == 0
    assert decontaminate.report(docs.limit(0), benchmark).count() == 0
    digest = {r["doc_id"]: (r["n_items"], r["items_sha256"]) for r in decontaminate.report(docs, benchmark).collect()}
    assert digest[3] == (2, hashlib.sha256(b"w,z").hexdigest())


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from skein.session import get_or_create
spark = get_or_create("local[2]", "elsewhere", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
print(sorted((n, entry.queries()[n](spark, {sf!r}).count()) for n in {names!r}))
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Started from another folder, without PYTHONPATH."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = ["op7_quality", "op8_lm_score", "op10_decontamination", "pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, sf=SF, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(re.findall("'[a-z0-9_]+', [0-9]+", done.stdout)) == len(names)
