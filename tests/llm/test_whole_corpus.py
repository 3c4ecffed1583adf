"""Corpus operators lose nothing at the edges of their methods."""

from pyspark.sql import functions as F

from skein.llm import license_scan, mixing


def test_small_sources_beside_a_hot_one_get_their_target(spark):
    hot = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit(2000).cast("long").alias("size"))
    tail = spark.range(200).select((F.col("id") + 20_000).alias("doc_id"), F.format_string("tail%03d", "id").alias("source"), (F.col("id") + 1).alias("size"))
    entries = hot.unionByName(tail).select("*", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("order"), F.lit(1).cast("long").alias("copies"))
    rows = mixing.mix(entries).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(rows) == 201
    assert [r["source"] for r in rows if r["taken"] != int(r["target"])] == []


def test_licence_texts_with_a_word_inserted_are_found(spark):
    rows = []
    for label, text in license_scan.TEXTS.items():
        words = license_scan.words_of(text)
        rows += [(f"{label} {i}", label, " ".join([*words[:i], "inserted", *words[i:]])) for i in range(1, len(words))]
    docs = spark.createDataFrame(rows, "doc_id string, label string, text string").repartition(4)
    labels = {r["doc_id"]: r["labels"].split(",") for r in license_scan.report(docs).collect()}
    assert [r[0] for r in rows if r[1] not in labels[r[0]]] == []
