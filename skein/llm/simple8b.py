"""Simple-8b: a 4-bit selector and 60 bits of equally wide codes in each 64-bit word.

A blob holds the ids of consecutive documents. Ids are coded by their rank of frequency in the blob,
so that frequent ones are narrow; ids past the `ESCAPE_AT` most frequent are the escape code 0 and
stand in a list of their own. Codes are cut into blocks of BLOCK; the word at which each block
starts is kept, so that all blocks decode side by side.

Layout, little-endian: magic, ids, dictionary size, escapes, blocks, words (u32 each); dictionary
(u32); escapes (u32); first word of each block (u32); words (u64).
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x38623853
BLOCK = 1024
#: Codes of ids in the dictionary are 1 .. ESCAPE_AT - 1.
ESCAPE_AT = 1 << 12
#: Selector -> codes in a word and bits of a code; fixed values of the coding.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PAD = 60


def _choices(codes: np.ndarray) -> np.ndarray:
    """For each place of each block the selector that packs the most codes from there."""
    bits = np.zeros(codes.shape, np.uint8)
    for k in range((ESCAPE_AT - 1).bit_length()):
        bits += codes >= (1 << k)
    widest = {1: bits}
    for k in (2, 4, 8, 16, 32):
        half = widest[k // 2]
        widest[k] = half.copy()
        np.maximum(half[:, : -(k // 2)], half[:, k // 2 :], out=widest[k][:, : -(k // 2)])
    choice = np.full((len(codes), BLOCK), len(COUNTS) - 1, np.uint8)
    for j in range(len(COUNTS) - 1, -1, -1):
        n, k = int(COUNTS[j]), 1 << (int(COUNTS[j]).bit_length() - 1)
        fits = np.maximum(widest[k][:, :BLOCK], widest[k][:, n - k : n - k + BLOCK]) <= WIDTHS[j]
        choice[fits] = j
    return choice


def encode(ids: np.ndarray) -> bytes:
    """The blob of a sequence of ids below 2^32."""
    ids = ids.astype(np.uint32)
    if len(ids) and int(ids.max()) < 1 << 22:
        count = np.bincount(ids)
        known = np.flatnonzero(count)
        inverse, count = np.cumsum(count > 0)[ids] - 1, count[known]
    else:
        known, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
    by_count = np.argsort(-count, kind="stable")
    dictionary = known[by_count[: ESCAPE_AT - 1]]
    code_of = np.zeros(len(known), np.uint16)
    code_of[by_count[: ESCAPE_AT - 1]] = np.arange(1, len(dictionary) + 1)
    flat = code_of[inverse]
    escapes = ids[flat == 0]
    blocks = -(-len(ids) // BLOCK)
    codes = np.zeros((blocks, BLOCK + _PAD), np.uint16)
    whole = len(ids) // BLOCK
    codes[:whole, :BLOCK] = flat[: whole * BLOCK].reshape(whole, BLOCK)
    if blocks > whole:
        codes[whole, : len(ids) - whole * BLOCK] = flat[whole * BLOCK :]
    size = np.full(blocks, BLOCK)
    if blocks > whole:
        size[whole] = len(ids) - whole * BLOCK
    choice = _choices(codes)
    rows, at, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(rows):
        selector = choice[rows, at]
        steps.append((rows, at, selector))
        at = at + COUNTS[selector]
        more = at < size[rows]
        rows, at = rows[more], at[more]
    row, place, selector = (np.concatenate([s[k] for s in steps]) if steps else np.zeros(0, np.int64) for k in range(3))
    order = np.argsort(row * BLOCK + place, kind="stable")
    row, place, selector = row[order], place[order], selector[order]
    words = selector.astype(np.uint64) << np.uint64(60)
    wide = codes.reshape(-1)
    origin = row * (BLOCK + _PAD) + place
    for j in range(len(COUNTS)):
        own = np.flatnonzero(selector == j)
        if len(own):
            for k in range(COUNTS[j]):
                words[own] |= wide[origin[own] + k].astype(np.uint64) << np.uint64(k * WIDTHS[j])
    first = np.searchsorted(row, np.arange(blocks)).astype(np.uint32)
    head = np.array([MAGIC, len(ids), len(dictionary), len(escapes), blocks, len(words)], np.uint32)
    return b"".join(x.tobytes() for x in (head, dictionary.astype(np.uint32), escapes, first, words))


def decode(blob: bytes) -> np.ndarray:
    """The ids of a blob."""
    head = np.frombuffer(blob, np.uint32, 6)
    magic, n, n_dictionary, n_escapes, blocks, n_words = head.tolist()
    if magic != MAGIC:
        raise ValueError("not a blob of Simple-8b words")
    at = 24
    dictionary = np.frombuffer(blob, np.uint32, n_dictionary, at)
    at += 4 * n_dictionary
    escapes = np.frombuffer(blob, np.uint32, n_escapes, at)
    at += 4 * n_escapes
    first = np.frombuffer(blob, np.uint32, blocks, at).astype(np.int64)
    at += 4 * blocks
    words = np.frombuffer(blob[at:], np.uint64, n_words)
    selector = (words >> np.uint64(60)).astype(np.int64)
    row = np.repeat(np.arange(blocks), np.diff(np.append(first, n_words)))
    before = np.cumsum(COUNTS[selector]) - COUNTS[selector]
    origin = row * (BLOCK + _PAD) + before - before[first][row] if n_words else before
    codes = np.zeros(blocks * (BLOCK + _PAD), np.uint16)
    for j in range(len(COUNTS)):
        own = np.flatnonzero(selector == j)
        if len(own):
            mask = np.uint64((1 << int(WIDTHS[j])) - 1)
            for k in range(COUNTS[j]):
                codes[origin[own] + k] = (words[own] >> np.uint64(k * WIDTHS[j])) & mask
    flat = codes.reshape(blocks, BLOCK + _PAD)[:, :BLOCK].reshape(-1)[:n]
    ids = np.concatenate([[0], dictionary]).astype(np.uint32)[flat]
    ids[flat == 0] = escapes
    return ids
