"""The corpus operators against brute force, round trips and held-out labels, on small tables with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from skein.llm import decontaminate, license_scan, line_dedup, lm_score, media, mixing, quality, simhash, simple8b, token_store, warc

SF = "/root/testdata/sf0.001"
SOLID, ALNUM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen"
ROWS = [
    (1, "\n".join([LINE, "a b", LINE + " x", LINE + " y", LINE + " z"]), "s1"),
    (2, "\n".join(["start", LINE, "a b", LINE + " x", LINE + " y", LINE + " z", "end"]), "s1"),
    (2, "\n".join(["start", LINE, "a b", LINE + " x", LINE + " y", LINE + " z", "end"]), "s1"),
    (3, None, None), (4, "", "s2"), (5, " \n\t\n", "s2"), (6, "Released under the MIT License. " * 3, "s3"),
    (7, "GNU General Public License apache license CC-BY cc by", "s1"), (8, "é漢字 ŷ " * 4000, "s4"), (9, (LINE + "\n") * 300, "s4"), (None, "no id here", "s5"),
]


def lower(text):
    return (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module", params=["small", "corpus"])
def table(request, docs, corpus):
    return docs if request.param == "small" else corpus


def keyed(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_license_scan(table):
    got = keyed(license_scan.report(table))
    for r in table.collect():
        words = ALNUM.findall(lower(r["text"]))
        found = [(i, label) for label, phrase in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"]) == (len(words), len(found))
        assert (g["first_word"], g["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert g["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, g["base_labels"].split(","))) <= set(filter(None, g["labels"].split(",")))
        assert 0 <= g["score"] <= 1


def test_warc(spark):
    pages = spark.createDataFrame([(3, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (5, "v", ""), (4, "w", "é" * 5000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.report(pages).collect()}
    texts = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert set(got) == set(texts)
    for k, raw in texts.items():
        import base64

        first = min(i for i, t in texts.items() if t == raw)
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if first == k else ("revisit", first))


def test_media(docs):
    got = {}
    for r in media.report(docs).collect():
        got.setdefault(r["doc_id"], r)
    for doc_id, text, _ in ROWS:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        g = got[doc_id]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_mixing(corpus, docs):
    for table in (corpus, docs):
        rows = mixing.report(table).collect()
        assert len(rows) == table.count()
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        sizes = {r["doc_id"]: len(SOLID.findall(r["text"] or "")) for r in table.collect()}
        assert all(r["size"] == sizes[r["doc_id"]] for r in rows)
    source = {r["doc_id"]: r["source"] for r in corpus.collect()}
    taken, target = Counter(), {}
    for r in mixing.report(corpus).collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - t) <= max(60, 0.02 * t) for s, t in target.items())


def test_simhash(table):
    def fingerprint(text):
        words = SOLID.findall(lower(text))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = table.where("doc_id is not null").collect()
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = keyed(simhash.report(table.where("doc_id is not null")))
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{f:016x}", find(k)) for k, f in prints.items()}


def test_line_dedup(table):
    rows = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in table.collect()}, key=lambda r: r[:2])
    seen, expected = set(), {}
    for known, doc_id, text in rows:
        lines = text.split("\n") if text is not None else []
        size, gone = [len(SOLID.findall(x)) for x in lines], set()
        for start in range(len(lines)):
            words = 0
            for end in range(start, len(lines)):
                words += size[end]
                run = "\n".join(lines[start : end + 1])
                if words >= line_dedup.MIN_WORDS:
                    gone |= set(range(start, end + 1)) if run in seen else set()
                    seen.add(run)
                if words >= 250:
                    break
        expected[doc_id if known else None] = (len(lines), ",".join(map(str, sorted(gone))), hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in gone).encode()).hexdigest())
    got = keyed(line_dedup.report(table))
    assert {k: (r["n_lines"], r["removed_lines"], r["kept_sha256"]) for k, r in got.items()} == expected


def test_lm_score(table):
    rows = [(r["doc_id"], SOLID.findall(lower(r["text"])) + ["\0end"]) for r in table.collect()]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    count = Counter(w for k, words in rows if not held(k) for w in words)
    total = sum(count.values())
    got = keyed(lm_score.report(table))
    for k, words in rows:
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(k), len(words), sum(w in count for w in words), total)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in words), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_lm_probabilities_sum_to_one():
    cells = np.array([[2, 8, 3, 40], [2, lm_score._NEVER, 5, 9]])
    model = lm_score.Model(3, 10, 4, lm_score.learn_pairs(cells, True), lm_score.learn_triples(np.array([[2, 4, 7], [2, lm_score._NEVER, 3]])))
    pair, word = np.array([2.0, 1.0, 0.0, 0.0]), np.array([5.0, 3.0, 2.0, 0.0])
    lower = model.of_pairs(pair, np.full(4, 3.0), word)
    assert math.isclose(lower.sum(), 1.0)
    assert math.isclose(model.of_pairs(np.zeros(4), np.zeros(4), word).sum(), 1.0)
    assert math.isclose(model.of_triples(np.array([1.0, 1.0, 0.0, 0.0]), np.full(4, 2.0), lower).sum(), 1.0)


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), rng.integers(0, 1 << 63, 1000, np.uint64), np.array([0, 255, 256, (1 << 64) - 1], np.uint64)):
        assert (lm_score.unpack(lm_score.pack(values)) == values).all()
        assert (lm_score.unpack_sorted(lm_score.pack_sorted(np.sort(values))) == np.sort(values)).all()
        ids = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        assert (simple8b.decode(simple8b.encode(ids)) == ids).all()


def test_quality_ranks_held_out_labels(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.report(documents, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert sum(a > b for a in good for b in bad) > 0.95 * len(good) * len(bad)


def test_quality_without_labels_and_with_awkward_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.report(docs, none).collect()} == {0.5}


def test_token_ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, expected = 0, []
    for doc_id, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in token_store.report(docs).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected


def test_decontamination(spark, table):
    items = {"i1": LINE, "i2": "released under", "i3": "", "i4": LINE.replace("one", "zero")} | {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    windows = {}
    for item, text in items.items():
        words = ALNUM.findall(lower(text))
        for i in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[i : i + 13]), set()).add(item)
    sizes = {len(w) for w in windows}
    got = keyed(decontaminate.report(table, spark.createDataFrame(list(items.items()), "item_id string, text string")))
    for r in table.collect():
        words = ALNUM.findall(lower(r["text"]))
        hit, found = set(), set()
        for i in range(len(words)):
            for n in sizes:
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"]) == (len(words), len(hit), len(found))
        assert g["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert g["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(words))


def test_empty_tables_and_clashing_columns(spark, docs):
    none = docs.limit(0)
    benchmark = spark.createDataFrame([("a", "b c")], "item_id string, text string")
    for report in (license_scan.report, media.report, mixing.report, simhash.report, line_dedup.report, lm_score.report, token_store.report):
        assert report(none).count() == 0
    assert decontaminate.report(none, benchmark).count() == 0
    more = docs.selectExpr("*", "1 AS fp", "2 AS removed", "3 AS rank", "4 AS score", "5 AS spans", "6 AS kind", "7 AS line")
    assert line_dedup.dedup_lines(more).count() == len(ROWS)
    assert decontaminate.find_contamination(more, benchmark).count() == len(ROWS)
    assert simhash.keep_one(more).columns == more.columns
