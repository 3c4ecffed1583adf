"""Stored payloads: the image's bytes decoded by hand, features by plain loops, and reads of headers alone."""

import hashlib
import statistics
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.llm import media
from skein.llm._work import new_dir

TEXTS = {1: "a", 2: "a", 3: None, 4: "", 5: " ", 6: "x" * 192, 7: "x" * 193, 8: "é漢字 " * 70_000, 9: "line\nline\r\n\t\0end", None: "no id"}


def payload(text):
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % 192 or (0 if raw else 192))


def chunks(image):
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at = 8
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        assert struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + data)
        yield kind, data
        at += 12 + n


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3)


def test_what_is_stored_and_read_back(spark, docs):
    path = new_dir(spark, "media")
    rows = {r["doc_id"]: r for r in media.with_media(docs, path=path).collect()}
    assert set(rows) == set(TEXTS)
    for k, text in TEXTS.items():
        r, raw = rows[k], payload(text)
        with open(f"{path.removeprefix('file:')}/{r['shard']}", "rb") as f:
            f.seek(r["offset"])
            image = f.read(r["length"])
        parts = dict(chunks(image))
        width, height, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
        lines = zlib.decompress(parts[b"IDAT"])
        assert b"".join(lines[193 * i + 1 : 193 * (i + 1)] for i in range(height)) == raw
        assert (r["width"], r["height"], r["bit_depth"], r["colour_type"]) == (width, height, depth, colour) == (192, len(raw) // 192, 8, 0)
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
        count = Counter(raw)
        bins = "/".join(str(sum(n for c, n in count.items() if c // 64 == b)) for b in range(4))
        mode = min(c for c, n in count.items() if n == max(count.values()))
        mean, std = statistics.fmean(raw), statistics.pstdev(raw)
        assert r["feature"] == f"rows={len(raw) // 192};mean={mean:.4f};std={std:.4f};mode={mode};bins={bins}"
    same = lambda k: {c: rows[k][c] for c in rows[k].asDict() if c not in ("doc_id", "n_bytes")}
    assert same(1) == same(2) and same(3) == same(4) == same(5)


def test_metadata_needs_the_header_alone(spark, docs, tmp_path):
    """Payloads are overwritten; the metadata is read as before."""
    path = new_dir(spark, "media")
    index = media.write_shards(docs, path)
    before = sorted(map(tuple, media.read_headers(index, path).collect()))
    for r in index.collect():
        with open(f"{path.removeprefix('file:')}/{r['shard']}", "r+b") as f:
            f.seek(r["offset"] + media.HEADER_BYTES)
            f.write(b"?" * (r["length"] - media.HEADER_BYTES))
    assert sorted(map(tuple, media.read_headers(index, path).collect())) == before


def test_shards_are_bounded(spark, docs):
    index = media.write_shards(docs.coalesce(1), new_dir(spark, "media"), shard_bytes=2000).collect()
    assert len({r["shard"] for r in index}) > 2
    assert len(index) == len({payload(t) for t in TEXTS.values()})


def test_clashing_columns_repeated_rows_and_empty_tables(docs):
    more = docs.unionByName(docs).select("*", *[F.lit(5).alias(c) for c in ("digest", "width", "place", "n_bytes", "feature", "other")])
    got = media.with_media(more)
    assert got.count() == 2 * len(TEXTS)
    assert {r["other"] for r in got.collect()} == {5} and len(set(got.columns)) == len(got.columns)
    assert media.with_media(more.limit(0)).count() == 0
