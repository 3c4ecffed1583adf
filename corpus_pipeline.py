"""The corpus pipeline: `documents` filtered, deduplicated, decontaminated, mixed and encoded.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet in the shared folder and
read again as the next stage's `docs`. All but the last return the columns of `documents`. A stage's rows
are deleted once the next one's are written.

Null and empty texts have no words: the classifier scores them as empty, they are one group of near-duplicates, never
contaminated, stay once in the mix and give the end id only. Rows with null ids are kept or dropped like others and
come first in the files; rows of one id with different texts are decided each on its own, and of rows that agree in id
and text one is left. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, mixing, quality, simhash, token_store
from skein.llm._work import new_dir, remove, store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, then text hash."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages by the contamination rule."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken twice stands twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all rows, and per row its place, length and checksum, read from the files."""
    path = new_dir(spark, "token-ids")
    token_store.write_ids(docs, path)
    return token_store.read_ids(spark, path)


STAGES = [
    ("quality classifier", filter_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token ids", encode),
]

#: The classifier, the fingerprints and the vocabulary are beyond SQL; tests compare each stage's rows with a plain program's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs, written = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, written = written, new_dir(spark, name.replace(" ", "-"))
        docs = store(stage(spark, docs, sf_dir), name, written)
        if before:
            remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
