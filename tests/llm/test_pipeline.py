"""Every stage of the pipeline against a plain program over the rows that the stage before it kept."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

import corpus_pipeline as pipeline
from skein.llm import mixing, quality

SF = "/root/testdata/sf0.001"
SOLID, ALNUM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(LOWER)


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0)


def near_duplicates(rows):
    def fingerprint(text):
        words = SOLID.findall(lower(text))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(j)] = find(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return [min(g, key=key) for g in groups.values()]


def clean(rows, items):
    windows = {tuple(w[i : i + 13]) for w in (ALNUM.findall(lower(t)) for t in items) if w for i in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}

    def contaminated(text):
        words = ALNUM.findall(lower(text))
        hit = {p for n in sizes for i in range(len(words)) if tuple(words[i : i + n]) in windows for p in range(i, i + n)}
        return len(hit) > 0 and 20 * len(hit) >= len(words)

    return [r for r in rows if not contaminated(r["text"])]


def mixed(rows):
    taken = Counter()
    sizes = Counter()
    size = {id(r): len(SOLID.findall(r["text"] or "")) for r in rows}
    for r in rows:
        sizes[r["source"]] += size[id(r)]
    from test_mixing import plain_targets

    target, out = plain_targets(sizes), []
    for source in sizes:
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}|{r['text'] or ''}".encode()).hexdigest())
        start = 0
        for r in own:
            n = size[id(r)]
            taken = sum(max(0, min(start + k * sizes[source] + n, int(target[source])) - (start + k * sizes[source])) for k in range(2))
            out += [r] * (1 if n == 0 else int(taken / n + 0.5))
            start += n
    return out


def tokens(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, out = 0, []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def same(frame, rows):
    assert Counter(map(str, frame.collect())) == Counter(map(str, rows))


AWKWARD = [(None, "no id at all", "en", "s1", 12), (900, None, "en", None, 0), (901, "", "en", "s1", 0), (0, "another text under a known id, of its own words only", "en", "s2", 50)]


@pytest.mark.parametrize("more", [[], AWKWARD])
def test_stages_equal_plain_programs(spark, more):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)) if more else docs
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(pipeline.STAGES)
    kept = pipeline.store(stages["quality classifier"](spark, docs, SF), "test")
    model = quality.fit(docs, labels)
    good = [r for r in docs.collect() if model.scores([(r["text"] or "").encode()])[0] >= 0.5]
    same(kept, good)
    kept = pipeline.store(stages["near-duplicates"](spark, kept, SF), "test")
    rows = near_duplicates(good)
    same(kept, rows)
    kept = pipeline.store(stages["decontamination"](spark, kept, SF), "test")
    rows = clean(rows, [r["text"] for r in benchmark.collect()])
    same(kept, rows)
    kept = pipeline.store(stages["source mixing"](spark, kept, SF), "test")
    rows = mixed(rows)
    same(kept, rows)
    assert len(rows) > 20 and mixing.SHARE == 1.5
    last = stages["token ids"](spark, kept, SF)
    assert sorted(map(tuple, last.collect()), key=lambda r: r[1]) == tokens(rows)
    if not more:
        assert sorted(map(tuple, pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == tokens(rows)


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
