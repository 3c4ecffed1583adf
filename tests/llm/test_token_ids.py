"""Token files of the small corpus, special tokens and awkward columns, against the tokenizer itself."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import token_store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(rows, tokenizer):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in token_store.report(frame).collect()), key=lambda r: r[1])


def test_small_corpus(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(docs.repartition(5, "lang")) == expected([(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)


def test_special_tokens_and_clashing_columns(spark, tokenizer):
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    rows = [(1, f"before {s} after{s}{s}") for s in special] + [(2, "don't  we'LL\n\n x\t　y  z"), (2, "don't"), (3, None), (None, "x"), (4, "a" * 70_000), (5, "\U0001f600" * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    more = frame.select("*", *[F.lit(1).alias(c) for c in ("part", "seq", "blob", "sizes", "n_ids", "at", "start")])
    assert got(more) == expected(rows, tokenizer)
    assert token_store.report(more.limit(0)).count() == 0
