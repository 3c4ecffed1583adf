"""WARC archives: what is written and read back, for awkward rows, in any layout."""

import base64
import gzip
import hashlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skein.llm import warc

ROWS = [(3, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (5, "v", ""), (4, "w x\n", "é\r\n\r\nWARC/1.1\r\n" * 5000), (None, None, "<p>a</p>"), (None, "n", "alone")]
ROWS += [(7, "u", "same"), (7, "u", "same"), (7, "u", "same"), (6, None, "same"), (9, "p", "x" * 500_000), (8, "h", "hot"), *[(100 + i, "h", "hot") for i in range(300)]]


def digest(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def expected(rows, min_bytes=0):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or "", rows[i][1] is None))
    first, out = {}, Counter()
    for i in order:
        page, _, html = rows[i]
        raw = (html or "").encode()
        if len(raw) >= min_bytes and raw in first:
            out[page, len(raw), digest(raw), "revisit", first[raw]] += 1
        else:
            first.setdefault(raw, page)
            out[page, len(raw), digest(raw), "response", None] += 1
    return out


def got(frame):
    return Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in frame.collect())


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string")


def test_round_trip_in_any_layout(pages):
    for frame in (pages.repartition(3), pages.coalesce(1), pages.select("*", *[F.lit(1).alias(c) for c in ("digest", "n", "key", "copy", "first")])):
        assert got(warc.report(frame)) == expected(ROWS)


def test_small_payloads_are_all_responses(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, min_bytes=5)
    assert got(warc.captures(spark, path)) == expected(ROWS, 5)


def test_string_ids_and_empty_tables(spark, pages):
    rows = [("b", "u", "x"), ("a\r\nq", "u", "x"), ("null", None, "y"), (None, None, "z")]
    frame = spark.createDataFrame(rows, "page_id string, url string, html string")
    assert got(warc.report(frame)) == Counter({("a\r\nq", 1, digest(b"x"), "response", None): 1, ("b", 1, digest(b"x"), "revisit", "a\r\nq"): 1, ("null", 1, digest(b"y"), "response", None): 1, (None, 1, digest(b"z"), "response", None): 1})
    assert warc.report(pages.limit(0)).count() == 0


def test_payloads_and_transactions(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    for file in Path(path).glob("*.gz"):
        content = gzip.decompress(file.read_bytes())
        assert not content or (content.startswith(b"WARC/1.1\r\n") and content.endswith(b"\r\n\r\n"))
    whole = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(whole) == len(ROWS) == len({r["capture"] for r in whole})
    assert all(r["request"] is not None and r["metadata"] is not None for r in whole)
    payloads = [bytes(r["response"]["payload"]) for r in whole if r["response"]["record_type"] == "response"]
    assert sorted(payloads) == sorted({(h or "").encode() for _, _, h in ROWS})


def test_the_hot_payload_is_combined_before_the_shuffle(pages):
    from skein import plans

    assert plans.count_nodes(warc.responses(pages), "SortAggregate") == 2  # one of them in the tasks that read
