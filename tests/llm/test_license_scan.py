"""Licence scan: labels and score against a plain program that follows the diagonals, and texts with words inserted, left out or changed."""

import re

import pytest
from pyspark.sql import functions as F

from skein.llm import license_scan as scan

SF = "/root/testdata/sf0.001"
TEMPLATES = [(label, True, text) for label, text in scan.PHRASES.items()] + [(label, False, text) for label, text in scan.TEXTS.items()]


def spans(words, template, base):
    """(first, part) of each span of a template's words in a text's."""
    pairs = {}
    for at, pair in enumerate(zip(words, words[1:])):
        pairs.setdefault(pair, []).append(at)
    hits = [(at, place) for place, pair in enumerate(zip(template, template[1:])) for at in pairs.get(pair, [])]
    diagonals = {}
    for at, place in hits:
        diagonals.setdefault(at - place, []).append((at, place))
    if base:
        return [(min(v)[0], 1.0) for v in diagonals.values() if len({p for _, p in v}) == len(template) - 1]
    # Diagonals that reach each other over steps of NEIGHBOUR at most.
    groups = []
    for d in diagonals:
        near = [g for g in groups if any(abs(d - e) <= scan.NEIGHBOUR for e in g)]
        groups = [g for g in groups if g not in near] + [{d}.union(*near)]
    out = []
    for group in groups:
        span, end = [], None
        for first, d in sorted((min(diagonals[d])[0], d) for d in group):
            if end is not None and first > end + len(template):
                out.append(span)
                span = []
            span = span + diagonals[d]
            end = max([max(diagonals[d])[0] + 1] + ([end] if end is not None else []))
        out.append(span)
    parts = [(min(s)[0], len({p + i for _, p in s for i in (0, 1)}) / len(template)) for s in out]
    return [(first, part) for first, part in parts if part >= scan.COVER]


def plain(text):
    words = scan.words_of(text or "")
    found = [(label, base, *s) for label, base, t in TEMPLATES for s in spans(words, scan.words_of(t), base)]
    base = [f for f in found if f[1]]
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min((f[2] for f in base), default=None), "last_word": max((f[2] for f in base), default=None),
        "base_labels": ",".join(sorted({f[0] for f in base})), "labels": ",".join(sorted({f[0] for f in found})), "score": max((f[3] for f in found), default=0.0), "n_texts": len(found) - len(base),
    }


def check(frame):
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in scan.report(frame).collect():
        row = r.asDict()
        assert {c: v for c, v in row.items() if c != "doc_id"} == plain(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_labels_and_scores_equal_a_plain_program(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def changed(words, i, kind):
    if kind.isdigit():
        return [*words[:i], *["dear", "very", "gentle", "reader"][: int(kind)], *words[i:]]
    return [*words[:i], *([] if kind == "dropped" else ["altered"]), *words[i + 1 :]]


@pytest.mark.parametrize("kind", ["1", "2", "4", "dropped", "altered"])
def test_changed_texts_are_found(spark, kind):
    rows = []
    for label, text in scan.TEXTS.items():
        words = scan.words_of(text)
        if len(words) >= 15:
            rows += [(f"{label} {i}", label, "Some words before. " + " ".join(changed(words, i, kind)) + " and some behind.") for i in range(1, len(words) - 1)]
    docs = spark.createDataFrame(rows, "doc_id string, label string, text string").repartition(4)
    check(docs)
    labels = {r["doc_id"]: r["labels"].split(",") for r in scan.report(docs).collect()}
    assert [r[0] for r in rows if r[1] not in labels[r[0]]] == []


def test_awkward_rows(spark):
    long = " ".join([scan.TEXTS["mit-text"], "filler " * 50, scan.TEXTS["gpl-text"], "cc by"] * 300)
    rows = [(1, None), (2, ""), (3, "-- ;"), (4, "MIT"), (5, long), (6, long), (7, "é mit license é"), (8, "the license " * 500), (9, " ".join(scan.words_of(scan.TEXTS["apache-text"])[:15]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(frame)
    again = frame.unionByName(frame).select("*", *[F.lit(1).alias(c) for c in ("words", "rid", "gram", "at", "template", "base", "size", "h")])
    assert sorted(map(str, scan.report(again).collect())) == sorted(2 * list(map(str, scan.report(frame).collect())))
    assert scan.report(frame.limit(0)).count() == 0
    assert re.fullmatch("gpl-text,mit-text", ",".join(sorted(s["template"] for s in {s["template"]: s for s in scan.scan(frame).where("doc_id = 5").first()["found"]}.values() if not s["base"])))
