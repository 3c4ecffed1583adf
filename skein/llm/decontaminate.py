"""Benchmark decontamination: an FM-index per training shard, searched with the benchmark's phrases.

Each task cuts its rows into shards of bounded size, indexes a shard's words and searches all
phrases backwards through wavelet ranks; occurrences are located by sampled suffix positions and
their spans merged. Documents are never shuffled, so copies and hot sources cost nothing extra.
The benchmark is dealt into blocks of about `block_words` words, written to the shared folder, and each
block is a pass over the documents' partitions whose tasks read it there. Between passes the rows
are written with the spans found so far, so a task holds one block however many there are.

Words outside the block's vocabulary can't be part of an occurrence; a run of them is one
separator in the index. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import _text
from skein.llm._work import filesystem, give_back, kept_in_worker, new_dir, remove, store
from skein.llm.fm_index import FMIndex
from skein.llm.prefix_sums import numbered

#: Words of one phrase.
WINDOW = 13
#: Words of the benchmark that one pass searches for.
BLOCK_WORDS = 500_000

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _null_first(item: str | None) -> tuple[bool, str]:
    return item is not None, item or ""


class Phrases:
    """The distinct phrases of some benchmark items, as rows of word numbers, and the items that have each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        words = _text.Words([text for _, text in items], _text.ALNUM_BYTE)
        self.vocabulary, number = np.unique(words.hashes(), return_inverse=True)
        number = (number + 1).astype(np.int32)
        size = np.minimum(words.counts(), window)
        places = np.where(size > 0, words.counts() - size + 1, 0)
        item = np.repeat(np.arange(len(items)), places)
        first = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places) + words.first[item]
        # Aligned to the right; a shorter item's phrase begins with zeros.
        column = np.arange(window) - (window - size[item])[:, None]
        at = np.clip(first[:, None] + column, 0, max(len(number) - 1, 0))
        rows = np.where(column >= 0, number[at], 0) if len(number) else np.zeros((0, window), np.int32)
        self.matrix, phrase = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.matrix > 0).sum(axis=1)
        self.items = sorted({x for x, _ in items}, key=_null_first)
        place = {x: i for i, x in enumerate(self.items)}
        own = np.array([place[x] for x, _ in items], np.int64)[item]
        pairs = np.unique(phrase.reshape(-1) * max(len(self.items), 1) + own)
        self.owner = pairs % max(len(self.items), 1)
        self.owner_start = np.searchsorted(pairs // max(len(self.items), 1), np.arange(len(self.matrix) + 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1; 0 for words that no phrase has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def occurrences(words: _text.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every place in a shard where a phrase stands within one text."""
    none = np.zeros(0, np.int64)
    number = phrases.numbers(words.hashes())
    if not number.any() or not len(phrases.lengths):
        return none, none
    # A separator ends each text; a run of foreign words and ends is one separator.
    ends = words.first[1:]
    sequence = np.insert(number, ends, 0)
    place = np.insert(np.arange(len(number)), ends, -1)
    keep = np.ones(len(sequence), bool)
    keep[1:] = (sequence[1:] != 0) | (sequence[:-1] != 0)
    sequence, place = sequence[keep], place[keep]
    index = FMIndex(sequence, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.matrix, phrases.lengths)
    count = np.maximum(hi - lo, 0)
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return phrase, place[index.locate(rows)]


def merged(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return edge[0::2], edge[1::2] - 1


def search_shard(texts: list[bytes], phrases: Phrases, known: list | None) -> list[tuple[int, list, list]]:
    """(n_words, merged spans, items) of each text; `known` are an earlier block's spans and items."""
    words = _text.Words(texts, _text.ALNUM_BYTE)
    phrase, first = occurrences(words, phrases)
    length = phrases.lengths[phrase] if len(phrase) else phrase
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + length, -1)
    marked = np.cumsum(change)[:-1] > 0
    found: dict[int, set] = {}
    if len(phrase):
        text = np.searchsorted(words.first, first, "right") - 1
        own = phrases.owner_start[phrase + 1] - phrases.owner_start[phrase]
        which = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(phrases.owner_start[phrase], own)
        for pair in np.unique(np.repeat(text, own) * len(phrases.items) + phrases.owner[which]):
            found.setdefault(int(pair) // len(phrases.items), set()).add(phrases.items[int(pair) % len(phrases.items)])
    out = []
    touched = set(found)
    for i, n in enumerate(words.counts().tolist()):
        before = known[i] if known else None
        if i not in touched and not (before and before[0]):
            out.append((n, [], []))
            continue
        hit = marked[words.first[i] : words.first[i + 1]].copy()
        items = set(found.get(i, ()))
        if before:
            for span in before[0]:
                hit[span["first"] : span["last"] + 1] = True
            items |= set(before[1])
        a, b = merged(hit)
        out.append((n, [{"first": x, "last": y} for x, y in zip(a.tolist(), b.tolist())], sorted(items, key=_null_first)))
    return out


def write_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> tuple[str, list[int]]:
    """Write the items that have words as one folder per block of about `block_words` words; the path and the blocks' numbers.

    Items are placed by a prefix sum of their words, so a block exceeds its size by at most its last item.
    """
    spark = benchmark.sparkSession
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), _text.UPPER, _text.LOWER)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), lower.alias("text"))
    items = items.withColumn("n", F.regexp_count("text", F.lit(_text.ALNUM_WORD)).cast("long")).where("n > 0").distinct()
    placed = numbered(items, ["item", "text"]).withColumn("block", F.floor(F.col("rank") / block_words))
    path = new_dir(spark, "benchmark")
    placed.select("item", "text", "block").write.partitionBy("block").parquet(path)
    numbers = spark.read.schema("item string, text string, block long").parquet(path).select("block").distinct()
    return path, sorted(r["block"] for r in numbers.collect())


def _phrases_of(folder: str, window: int) -> Phrases:
    """The phrases of a block, built once in a worker, which keeps those of one block."""
    import pyarrow.parquet as pq

    kept = kept_in_worker("phrases", dict)
    if (folder, window) not in kept:
        kept.clear()
        files, root = filesystem(folder)
        table = pq.ParquetDataset(root, filesystem=files, partitioning=None).read(columns=["item", "text"])
        kept[folder, window] = Phrases(list(zip(table.column("item").to_pylist(), _text.to_bytes(table.column("text")))), window)
    return kept[folder, window]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All rows and columns of `docs` with n_words, merged hit spans and the items that occur.

    A null or empty text has no words and no hits. Items without words have no phrases; rows of one item id are one
    item, and a null id is an item of its own, listed as null before all others. Repeated rows of either table are
    searched like any other. Columns of `docs` named n_words, spans or items are replaced. Either table may be empty.
    """
    base = docs.drop(*[f.name for f in ADDED])
    schema = T.StructType([*base.schema.fields, *ADDED])
    path, numbers = write_blocks(benchmark, item_col, item_text_col, block_words)
    folders = [f"{path}/block={k}" for k in numbers] or [None]
    out, written = base, None
    for i, folder in enumerate(folders):
        out = out.mapInArrow(_pass(folder, window, text_col, i > 0, [f.name for f in base.schema.fields]), schema)
        if i + 1 < len(folders):  # a pass ends before the next begins, so that one block is held at a time
            before, written = written, new_dir(docs.sparkSession, "spans")
            out = store(out, "spans", written)
            if before:
                remove(docs.sparkSession, before)
    return out


def _pass(folder: str | None, window: int, text_col: str, again: bool, columns: list[str]):
    def run(batches):
        import pyarrow as pa

        phrases = _phrases_of(folder, window) if folder else Phrases([], window)
        spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            for part, texts in _text.sliced(batch, text_col):
                known = list(zip(part.column("spans").to_pylist(), part.column("items").to_pylist())) if again else None
                rows = search_shard(texts, phrases, known)
                added = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], spans), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *added], [*columns, "n_words", "spans", "items"])
                del part, texts, known
            del batch
            give_back()

    return run


def n_hit() -> "F.Column":
    """Words inside the merged spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def contaminated() -> "F.Column":
    """The contamination rule: some word is hit, and at least one in twenty."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with their own columns."""
    return find_contamination(docs, benchmark, **options).where(~contaminated()).select(*[c for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, words hit, items that occur and the verdict."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
