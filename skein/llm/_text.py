"""Vectorised splitting and hashing of UTF-8 texts inside Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from skein.llm._work import kept_in_worker

#: Texts are handled in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of lower-cased text as patterns for columns.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SOLID_WORD = r"[^\x20\x09-\x0D]+"

#: A-Z to a-z and nothing else.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text.
ALNUM_BYTE = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])

#: Bytes of words [^\x20\x09-\x0D]+.
SOLID_BYTE = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])

_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_BYTE_VALUE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def to_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def sliced(batch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[tuple]:
    """Consecutive parts of an Arrow batch of about `limit` bytes of text together, each with its texts.

    Only one part's texts are copied out of the batch at a time.
    """
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    for a, b in ranges(sizes, limit):
        part = batch.slice(a, b - a)
        yield part, to_bytes(part.column(text_col))


def ranges(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of these sizes, of about `limit` bytes together."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size + 1
    if start < len(sizes):
        yield start, len(sizes)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    # Not a variable of this module: those travel with every function that is sent to a worker.
    powers = kept_in_worker("powers", dict)
    if "up" not in powers or len(powers["up"]) < n:
        size = max(n, SLICE_BYTES + 65536)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, factor in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            powers[name] = np.multiply.accumulate(steps)
    return powers["up"][:n], powers["down"][:n]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]: a polynomial over the bytes, then a finaliser."""
    up, down = _powers(len(buf))
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * up, out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _BASE)


class Words:
    """The words of a list of texts: byte spans in one buffer, and each text's range of words."""

    def __init__(self, texts: list[bytes], word_byte: np.ndarray, lower: bool = True):
        joined = b"\n".join([*texts, b""]) if texts else b""
        if lower:
            joined = joined.translate(ASCII_LOWER)
        self.buf = np.frombuffer(joined, np.uint8)
        solid = np.zeros(len(self.buf) + 1, np.int8)
        solid[:-1] = word_byte[self.buf]
        edge = np.flatnonzero(np.diff(solid, prepend=np.int8(0)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        #: Words of text i: first[i] .. first[i + 1] - 1
        self.first = np.searchsorted(self.starts, self.text_start)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends) if len(self) else np.zeros(0, np.uint64)
