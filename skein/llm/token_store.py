"""Token ids in binary files: each document's ids in ascending document order, Simple-8b coded.

Rows are range-partitioned by id and sorted; each task encodes its texts in slices of bounded size
and writes one blob per slice. A blob row carries its documents' ids and lengths, so a reader
finds any document from the small columns. Only the texts are shuffled, once.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import _text, simple8b
from skein.llm._work import give_back, kept_in_worker, new_dir

#: The tokenizer file of `public_tokenizers` used unless another is named.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Encoded pieces a Python worker remembers.
MEMORY = 2_500_000

# Kinds of bytes at which the vocabulary's pattern always splits, whatever stands around them.
_SPACE, _LINE, _LETTER, _MARK, _APOSTROPHE, _OTHER = range(6)
_KIND = np.array(
    [
        _SPACE if c == 0x20 else _LINE if c == 0x0A else _APOSTROPHE if c == 0x27 else _OTHER if c < 0x20 or c >= 0x7F
        else _LETTER if chr(c).isalpha() else _OTHER if chr(c).isdigit() else _MARK
        for c in range(256)
    ],
    np.uint8,
)
# A byte that begins a visible character; bytes that can begin other white space don't count.
_VISIBLE = np.array([0x20 < c < 0x7F or (c >= 0xC3 and c not in (0xE1, 0xE2, 0xE3)) for c in range(256)])


def _cuts() -> np.ndarray:
    """[kind of a byte * 2 + its visibility, the same of the next]: whether to cut between them."""
    cut = np.zeros((6, 2, 6, 2), bool)
    cut[_LINE, :, [_LETTER, _MARK, _APOSTROPHE, _OTHER], 1] = True
    cut[[_LETTER, _MARK, _APOSTROPHE], :, _LINE, :] = True
    cut[_LETTER, :, [_MARK, _APOSTROPHE], :] = True
    cut[_MARK, :, _LETTER, :] = True
    return cut


_CUT = _cuts().reshape(-1)


class Encoder:
    """Encodes texts piece by piece, each different piece once.

    The byte-level vocabulary splits text by a pattern before any merge: always before a space that
    a visible character follows, at a line feed next to a visible character, and between letters and
    marks (an apostrophe may belong to the letters after it). So texts are cut there, pieces are
    found by 64-bit hash, and the library encodes those not met before.
    """

    def __init__(self, name: str = TOKENIZER):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[place] == hashes

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        at = np.cumsum(size) - size + len(self.pool)
        self.pool = np.concatenate([self.pool, ids])
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, place, hashes[order])
        self.at, self.size = np.insert(self.at, place, at[order]), np.insert(self.size, place, size[order])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by END_ID, and the number of each text's ids with it."""
        import pandas as pd

        joined = b"".join(texts)
        buf = np.frombuffer(joined, np.uint8)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(length) - length
        first = np.zeros(len(buf) + 1, bool)
        first[start] = True
        cut = np.zeros(len(buf) + 1, bool)
        kind = _KIND[buf] * np.uint8(2) + _VISIBLE[buf]
        cut[1 : len(buf)] = _CUT[kind[:-1] * np.uint8(12) + kind[1:]]
        # After a line feed only if it stands alone: of more white space the pattern takes all but the last.
        after_line = np.flatnonzero(cut[1 : len(buf)] & (buf[:-1] == 0x0A)) + 1
        cut[after_line[~(cut | first)[after_line - 1]]] = False
        cut[: max(len(buf) - 1, 0)] |= (buf[:-1] == 0x20) & _VISIBLE[buf[1:]] & ~first[1:-1]
        for i, text in enumerate(texts):
            if any(x in text for x in self.special):  # such a string is one id, whatever stands in it
                cut[start[i] : start[i] + length[i]] = False
        begin = np.flatnonzero((cut | first)[: len(buf)])
        end = np.append(begin[1:], len(buf))[: len(begin)]
        hashes = _text.hash_spans(buf, begin, end) if len(begin) else np.zeros(0, np.uint64)
        inverse, known = pd.factorize(hashes)
        sample = np.zeros(len(known), np.int64)
        sample[inverse[::-1]] = np.arange(len(inverse))[::-1]
        if len(self.hashes) + len(known) > MEMORY:
            self._forget()
        new = ~self._has(known)
        if new.any():
            pieces = [joined[begin[i] : end[i]].decode("utf-8", "replace") for i in sample[new].tolist()]
            self._learn(known[new], pieces)
        place = np.searchsorted(self.hashes, known)
        size, at = self.size[place][inverse], self.at[place][inverse]
        # The pieces of a text, then its end: an entry of one id taken from the end of the pool.
        pool = np.append(self.pool, np.uint32(END_ID))
        piece_of_end = np.searchsorted(begin, start + length)
        size = np.insert(size, piece_of_end, 1)
        at = np.insert(at, piece_of_end, len(pool) - 1)
        total = np.cumsum(size)
        ids = pool[np.arange(total[-1] if len(total) else 0) + np.repeat(at - total + size, size)]
        last = piece_of_end + np.arange(len(texts))
        return ids, np.diff(total[last], prepend=0)


FILE_SCHEMA = "part int, seq int, doc_ids array<{id}>, sizes array<long>, n_ids long, blob binary"


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> None:
    """Write the ids of all texts below `path`, in ascending order of ids (nulls first, equal ids by text).

    Null texts count as empty and give the end id only.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = kept_in_worker(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        for batch in batches:
            for slice_, texts in _text.sliced(batch, "text"):
                ids, sizes = encoder.encode(texts)
                names = slice_.column("doc_id")
                lists = [pa.array([x], pa.list_(t)) for x, t in ((names.to_pylist(), names.type), (sizes.tolist(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), *lists, pa.array([len(ids)], pa.int64()), pa.array([simple8b.encode(ids)], pa.binary())],
                    ["part", "seq", "doc_ids", "sizes", "n_ids", "blob"],
                )
                seq += 1
            del batch
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    rows.mapInArrow(run, FILE_SCHEMA.format(id=kind)).write.parquet(path)


def blob_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq and the number of ids before each blob: sums per part, then within parts."""
    sizes = spark.read.parquet(path).select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return sizes.select("part", "seq", within.alias("within")).join(before, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("blob_start"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files below `path`."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("doc_id", kind)]
        + [T.StructField(c, T.LongType()) for c in ("at", "n_tokens", "ids_crc32")]
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                raw = simple8b.decode(one.column("blob")[0].as_py()).astype("<u4").tobytes()
                names, sizes = one.column("doc_ids").flatten(), np.array(one.column("sizes").flatten())
                at = np.cumsum(sizes) - sizes
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), sizes.tolist())]
                same = lambda c, k: pa.array(np.full(k, one.column(c)[0].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [same("part", len(names)), same("seq", len(names)), names, pa.array(at), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(run, schema).join(blob_starts(spark, path), ["part", "seq"])
    return rows.select("doc_id", (F.col("blob_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def report(docs: DataFrame) -> DataFrame:
    """Encode all documents to files in the shared folder and read their positions and checksums back."""
    path = new_dir(docs.sparkSession, "token-ids")
    write_ids(docs, path)
    return read_ids(docs.sparkSession, path)
