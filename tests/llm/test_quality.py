"""The quality classifier against a plain program, and its independence of batches and layouts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


def test_a_text_has_the_same_features_alone_and_in_any_batch(tables):
    texts = [(r["text"] or "").encode() for r in tables[0].select("text").collect()] + [b"a " * 2000, b"a " * 2000, b"", b"a", b"a"]
    alone = [quality.features([t])[0] for t in texts]
    for seed in (1, 2):
        order = list(range(len(texts)))
        random.Random(seed).shuffle(order)
        index, first = quality.features([texts[i] for i in order])
        for k, i in enumerate(order):
            assert (index[first[k] : first[k + 1]] == alone[i]).all()


def test_no_score_depends_on_the_layout(tables):
    docs, labels = tables
    more = docs.unionByName(docs.select(F.lit(5_000_000).cast("long").alias("doc_id"), F.lit("a " * 20_000).alias("text"), "lang", "source", "n_chars").limit(2))
    got = [sorted((r["doc_id"], r["score"]) for r in quality.report(x, labels).collect()) for x in (more, more.repartition(7, "doc_id"), more.coalesce(1))]
    assert got[0] == got[1] == got[2]


def plain_fit(rows, labels, bits):
    """Ratios and weights by plain loops, without the scale."""
    own = [k for k in range(len(rows)) if k % quality.SCALE_PART != quality.SCALE_PART - 1]
    count = [[1.0] * (1 << bits) for _ in range(2)]
    for k in own:
        for f in rows[k]:
            count[labels[k]][f] += 1
    ratio = [math.log((b / sum(count[1])) / (a / sum(count[0]))) for a, b in zip(*count)]
    own = [k for k in own if rows[k]]
    norm = {k: max(math.sqrt(sum(ratio[f] ** 2 for f in rows[k])), 1e-9) for k in own}
    of_class = [sum(labels[k] == c for k in own) for c in (0, 1)]
    weight, bias, alpha = [0.0] * (1 << bits), 0.0, [0.0] * len(rows)
    rng = np.random.default_rng(5)
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(np.array(own)).tolist():
            sign = 1 if labels[k] == 1 else -1
            margin = sign * (sum(weight[f] * ratio[f] / norm[k] for f in rows[k]) + bias)
            bound = quality.PENALTY * len(own) / (2 * max(of_class[labels[k]], 1))
            new = min(max(alpha[k] - (margin - 1) / 2, 0.0), bound)
            step, alpha[k] = (new - alpha[k]) * sign, new
            for f in rows[k]:
                weight[f] += step * ratio[f] / norm[k]
            bias += step
    return ratio, weight, bias


def test_fit_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 6)
    rng = random.Random(3)
    labels = [rng.randrange(2) for _ in range(40)]
    rows = [sorted(rng.sample(range(64), rng.randrange(0, 9)) + ([1] if y else [])) for y in labels]
    rows = [sorted(set(r)) for r in rows]
    first = np.cumsum([0, *map(len, rows)])
    flat = np.array([f for r in rows for f in r], np.uint32)
    model = quality.fit_rows(flat, first, np.array(labels))
    ratio, weight, bias = plain_fit(rows, labels, 6)
    assert model.ratio == pytest.approx(ratio)
    assert model.weight == pytest.approx(weight)
    assert model.bias == pytest.approx(bias)
    margins = model.margins(flat.astype(np.int64), first)
    for k, r in enumerate(rows):
        norm = max(math.sqrt(sum(ratio[f] ** 2 for f in r)), 1e-9)
        assert margins[k] == pytest.approx(sum(weight[f] * ratio[f] for f in r) / norm + bias)


def test_awkward_rows_are_scored_by_a_fitted_model(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, "no id"), (1, None), (2, ""), (3, "x" * 300_000), (4, "| | |"), (4, "| | |")], "doc_id long, text string")
    more = docs.select("doc_id", "text").unionByName(odd)
    clashing = more.select("*", *[F.lit(0).alias(c) for c in ("score", "predicted", "k", "y", "rows", "_y", "quality")])
    model = quality.fit(clashing, labels)
    scored = quality.with_score(clashing, model)
    assert scored.columns == [*[c for c in clashing.columns if c not in ("score", "predicted")], "score", "predicted"]
    rows = scored.collect()
    assert len(rows) == more.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["text"] in (None, "")}) == 1
    assert quality.report(docs.limit(0), labels).count() == 0


def test_training_rows_have_one_bound(tables, monkeypatch):
    docs, labels = tables
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda flat, first, y: seen.append(len(y)) or quality.constant(y))
    twice = docs.unionByName(docs)
    quality.fit(twice, labels, train_rows=50)
    quality.fit(twice, labels.unionByName(labels))
    usable = labels.where(~quality.held_out()).where("quality in (0, 1)").join(docs, "doc_id").count()
    assert seen == [50, 4 * usable]
