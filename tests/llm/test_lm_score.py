"""Language-model scores against a plain program, at one and at several levels of sums, and the growth of what is shuffled."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import lm_score

SF = "/root/testdata/sf0.001"
SOLID = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket(n):
    return n.bit_length()


def step(ratio):
    return round(math.log2(ratio) / lm_score.STEP) if ratio > 0 else None


def unstep(k):
    return 0.0 if k is None else 2.0 ** (k * lm_score.STEP)


def expectation_maximisation(cells, possible):
    """cells: Counter of (values of the parts); the weights of one bucket."""
    prior = [p / sum(possible) for p in possible]
    weights = list(prior)
    for _ in range(lm_score.ROUNDS):
        sums = list(prior)
        for values, n in cells.items():
            parts = [w * v for w, v in zip(weights, values)]
            for k, p in enumerate(parts):
                sums[k] += n * p / sum(parts)
        weights = [s / sum(sums) for s in sums]
    return weights


class Counts:
    def __init__(self, texts):
        self.texts, self.word, self.pair, self.triple = len(texts), Counter(), Counter(), Counter()
        for words in texts:
            self.word.update(words)
            self.pair.update(zip([None, *words], words))
            self.triple.update(zip(words, words[1:], words[2:]))
            self.triple.update([(None, *words[:2])] if len(words) > 1 else [])
        self.tokens = sum(self.word.values())

    def at(self, words, i):
        """Counts of the triple, its context, the pair, its context and the word."""
        v, w = words[i - 1] if i else None, words[i]
        context = self.word[v] if i else self.texts
        if i == 0:
            return self.pair[v, w], self.texts, self.pair[v, w], context, self.word[w]
        u = words[i - 2] if i > 1 else None
        return self.triple[u, v, w], self.pair[u, v], self.pair[v, w], context, self.word[w]


def plain(rows):
    """doc_id -> score of (doc_id, text) rows."""
    def kind(k):
        h = zlib.crc32(str(k).encode()) if k is not None else None
        return "unseen" if h is not None and h % 7 == 2 else "deleted" if h is not None and h // 7 % lm_score.DELETED_PART == 0 else "retained"

    texts = [(k, kind(k), [*SOLID.findall((t or "").translate(LOWER)), "\0end"]) for k, t in rows]
    kept, all_ = Counts([w for _, what, w in texts if what == "retained"]), Counts([w for _, what, w in texts if what != "unseen"])
    uniform = 1 / (len(all_.word) + 1)
    deleted = [w for _, what, w in texts if what == "deleted"]
    pair_cells, triple_cells = defaultdict(Counter), defaultdict(Counter)
    for words in deleted:
        for i in range(len(words)):
            _, _, pair, context, word = kept.at(words, i)
            two = pair / context if context else 0
            one = word / kept.tokens if kept.tokens else 0
            pair_cells[bucket(context)][unstep(step(two / uniform)), unstep(step(one / uniform)), 1.0] += 1
    some = float(all_.tokens > 0)
    weights = {b: expectation_maximisation(pair_cells[b], [some * (b > 0), some, 1.0]) for b in range(40)}

    def lower(counts, words, i):
        _, _, pair, context, word = counts.at(words, i)
        a, b, c = weights[bucket(context)]
        return a * pair / max(context, 1) + b * word / max(counts.tokens, 1) + c * uniform

    for words in deleted:
        for i in range(len(words)):
            triple, context, *_ = kept.at(words, i)
            triple_cells[bucket(context)][unstep(step(triple / max(context, 1) / lower(kept, words, i))), 1.0] += 1
    own = {b: expectation_maximisation(triple_cells[b], [float(b > 0), 1.0])[0] for b in range(40)}
    out = {}
    for k, _, words in texts:
        total = 0.0
        for i in range(len(words)):
            triple, context, *_ = all_.at(words, i)
            share = own[bucket(context)]
            total += math.log10(share * triple / max(context, 1) + (1 - share) * lower(all_, words, i))
        out.setdefault(k, []).append(total)
    return {k: sorted(v) for k, v in out.items()}


def scores(frame, **options):
    out = {}
    for r in lm_score.score(frame, **options).collect():
        out.setdefault(r["doc_id"], []).append(r["score"])
    return {k: sorted(v) for k, v in out.items()}


def same(got, expected):
    assert set(got) == set(expected)
    for k, values in expected.items():
        assert got[k] == pytest.approx(values, rel=1e-9), k


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of a few words that often repeat, and awkward rows, among them repeated, null and empty ones."""
    rows = [(i, " ".join("abcdefgh"[(i * k * k + k) % (3 + i % 6)] for k in range(i % 40))) for i in range(200)]
    rows += [(None, "a b c"), (None, "a b c"), (7, "a b c"), (500, None), (501, ""), (502, " \n"), (503, "é漢 " * 3000), (9, rows[9][1])]
    return rows


def test_scores_equal_a_plain_program(spark, corpus):
    frame = spark.createDataFrame(corpus, "doc_id long, text string")
    expected = plain(corpus)
    same(scores(frame.repartition(3)), expected)
    same(scores(frame.repartition(2), slice_tokens=100, batch=3), expected)


def test_scores_of_the_small_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = plain(rows)
    same(scores(docs), expected)
    same(scores(docs.repartition(5, "lang"), slice_tokens=5000, batch=4), expected)


def test_no_rows_to_learn_from(spark):
    held = [(k, "a b") for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2]
    got = lm_score.score(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert len(got) == len(held)
    assert {(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in got} == {(0, 0, 0.0, 0.0)}
    none = spark.createDataFrame([], "doc_id long, text string, slice int, kind int, n int")
    assert lm_score.score(none).count() == 0


def test_other_columns_may_have_any_name(spark, corpus):
    frame = spark.createDataFrame(corpus[:50], "doc_id long, text string")
    more = frame.select("*", *[F.lit(1).alias(c) for c in ("slice", "kind", "names", "sizes", "words", "seq", "n", "range", "source", "stage")])
    same(scores(more), scores(frame))


def test_packs_grow_with_the_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made = []
    for times in (1, 2, 4):
        more = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).select((F.col("doc_id") * times + F.col("copy")).alias("doc_id"), "text")
        slices = lm_score.slice_texts(more.repartition(2), "doc_id", "text", 20_000)
        made.append((slices.count(), lm_score.ask(slices).count()))
    per_slice = [packs / slices for slices, packs in made]
    assert max(per_slice) < 1.1 * min(per_slice)
