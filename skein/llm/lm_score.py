"""Language-model scores by deleted interpolation of trigram, bigram, unigram and uniform estimates.

P(w | v) = a * c(v, w) / c(v) + b * c(w) / N + (1 - a - b) / (V + 1), with weights of the bucket of c(v), and
P(w | u, v) = l * c(u, v, w) / c(u, v) + (1 - l) * P(w | v), with the weight of the bucket of c(u, v); a bucket is
the power of two below a count. Weights are learned by expectation-maximisation: counts come from the
retained training rows, and the tokens predicted are those of the deleted ones, a part of the training rows.
A text's first word has the start as its context in both mixtures.

Texts are tokenised once, into slices of many texts that are stored with the words' 64-bit hashes. A slice
asks once for each of its different words and pairs, in RANGES packs of hashes, and then for those triples whose two
pairs also stand in other slices; the count of any other triple is the slice's own. So the rows
shuffled are RANGES for each slice, in proportion to the input. Packs of one range from up to BATCH
slices are added up by one task; with more slices the sums of each batch ask again, in finer ranges, one level up,
and answers go down the same way. A common word is thus one entry of each batch however many texts have it.
Every count covers all training rows; only the weights, a few per bucket, reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import _text
from skein.llm._work import give_back, store

#: Tokens of one slice, about; a longer text is whole in one slice.
SLICE_TOKENS = 1_000_000
#: Binary logarithm of the packs that a slice's hashes are cut into, and how many sources' packs one task adds up.
RANGE_BITS = 8
BATCH = 256
#: Of the training rows, one in so many is deleted: its counts predict nothing while weights are learned.
DELETED_PART = 8
#: In expectation-maximisation, ratios of two estimates are rounded to this step of their binary logarithm.
STEP = 0.25
ROUNDS = 100
#: Binary logarithms of counts stay below this.
BUCKETS = 65
_NEVER = -(10**9)

#: What a slice's rows are: counted and retained, counted and deleted for the weights, or not learned from.
RETAINED, DELETED, UNSEEN = 0, 1, 2
START, END = np.uint64(0x5BD1E995A7C3F00D), np.uint64(0xC2B2AE3D27D4EB4F)
_PAIR, _TRIPLE, _ONE = np.uint64(0x9E3779B185EBCA87), np.uint64(0xD6E8FEB86659FD93), np.uint64(1)

SLICE = "slice long, kind int, names array<{id}>, sizes array<long>, n_tokens long, words binary, seq binary"
PACK = "source long, range long, wants boolean, items binary, n binary, kept binary, slices binary"
TOLD = "source long, range long, wants boolean, n binary, kept binary, slices binary, vocabulary long"


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id's text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def kind_of(id_col: str = "doc_id") -> Column:
    part = F.coalesce(F.floor(F.crc32(F.col(id_col).cast("string").cast("binary")) / 7) % DELETED_PART, F.lit(1))
    return F.when(held_out(id_col), UNSEEN).when(part == 0, DELETED).otherwise(RETAINED).cast("int")


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of their bytes, lowest first: high planes are zeros and compress away."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    used = 8 if len(values) == 0 else max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([used]) + np.ascontiguousarray(planes[:, :used].T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    used = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def _order(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes, and each one's place in it."""
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place


class Slice:
    """The different words and pairs of a slice and each token's pair. Hashes of words are odd, those of pairs even.

    items are both in the order of hashes, own their counts here; word_at and pair_at are places in items.
    """

    def __init__(self, words: np.ndarray, seq: np.ndarray, sizes: np.ndarray):
        self.words, self.seq, self.sizes = words, seq, sizes
        self.first = np.cumsum(sizes) - sizes
        before = np.zeros(len(seq), np.int64)  # 0: the start
        before[1:] = seq[:-1] + 1
        before[self.first] = 0
        codes, self.token_pair = np.unique(before * (len(words) + 1) + seq, return_inverse=True)
        del before
        self.left, self.right = codes // (len(words) + 1) - 1, codes % (len(words) + 1)
        known = np.concatenate([words, [START]])
        self.pairs = _text.mix(known[self.left] * _PAIR + words[self.right]) & ~_ONE if len(codes) else np.zeros(0, np.uint64)
        self.own_pair = np.bincount(self.token_pair, minlength=len(codes))
        both = np.concatenate([words, self.pairs])
        order, place = _order(both)
        self.items, self.own = both[order], np.concatenate([np.bincount(seq, minlength=len(words)), self.own_pair])[order]
        self.word_at, self.pair_at = place[: len(words)], place[len(words) :]

    @staticmethod
    def of(row) -> Slice:
        return Slice(unpack_sorted(row["words"]), unpack(row["seq"]).astype(np.int64), np.asarray(row["sizes"], np.int64))


class Triples:
    """The different triples of a slice: `left` and `last` are their two pairs; a text's first word has no left pair (-1)."""

    def __init__(self, s: Slice):
        before = np.zeros(len(s.seq), np.int64)
        before[1:] = s.token_pair[:-1] + 1
        before[s.first] = 0
        _, at, self.token = np.unique(before * (len(s.words) + 1) + s.seq, return_index=True, return_inverse=True)
        self.left, self.last = before[at] - 1, s.token_pair[at]
        self.own = np.bincount(self.token, minlength=len(at))

    def asked(self, s: Slice, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the triples whose pairs both stand in other slices too, and their hashes, in the order of hashes."""
        chosen = np.flatnonzero((self.left >= 0) & elsewhere[self.left] & elsewhere[self.last])
        hashes = _text.mix(s.pairs[self.left[chosen]] * _TRIPLE + s.words[s.right[self.last[chosen]]])
        order = np.argsort(hashes, kind="stable")
        return chosen[order], hashes[order]

    def counts(self, chosen: np.ndarray, told: np.ndarray, other: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Counts of all triples: those told, `other` for those not asked for, and of first words their pair's."""
        out = np.where(self.left >= 0, other, first[self.last]).astype(np.float64)
        out[chosen] = told
        return out


def slice_texts(docs: DataFrame, id_col: str, text_col: str, slice_tokens: int) -> DataFrame:
    """Rows of SLICE: texts of one kind, as places in the sorted hashes of the slice's words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), kind_of(id_col).alias("kind"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        waiting = {k: [] for k in (RETAINED, DELETED, UNSEEN)}

        def flush(kind):
            nonlocal made
            names = pa.concat_arrays([x[0] for x in waiting[kind]])
            sizes, tokens = (np.concatenate([x[i] for x in waiting[kind]]) for i in (1, 2))
            waiting[kind] = []
            words, seq = np.unique(tokens, return_inverse=True)
            made += 1
            values = [part << 24 | made, kind, names, sizes, len(tokens), pack_sorted(words), pack(seq)]
            types = [pa.int64(), pa.int32(), pa.list_(names.type), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            arrays = [pa.array([v.to_pylist() if isinstance(v, pa.Array) else v.tolist() if isinstance(v, np.ndarray) else v], t) for v, t in zip(values, types)]
            return pa.RecordBatch.from_arrays(arrays, ["slice", "kind", "names", "sizes", "n_tokens", "words", "seq"])

        for batch in batches:
            for piece, texts in _text.sliced(batch, "text", min(_text.SLICE_BYTES, 8 * slice_tokens)):
                kinds, names = np.array(piece.column("kind")), piece.column("doc_id")
                words = _text.Words(texts, _text.SOLID_BYTE)
                tokens = np.insert(words.hashes() | _ONE, words.first[1:], END)
                sizes = words.counts() + 1
                for kind in waiting:
                    own = kinds == kind
                    if own.any():
                        waiting[kind].append((names.filter(pa.array(own)), sizes[own], tokens[np.repeat(own, sizes)]))
                        if sum(len(x[2]) for x in waiting[kind]) >= slice_tokens:
                            yield flush(kind)
            del batch
            give_back()
        for kind, rest in waiting.items():
            if rest:
                yield flush(kind)

    return rows.mapInArrow(run, SLICE.format(id=docs.schema[id_col].dataType.simpleString()))


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    columns = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(columns)], [c for c, _ in columns])


def cut(hashes: np.ndarray, prefix: int, level: int) -> list[tuple[int, slice]]:
    """(range, places) of sorted hashes that share a prefix of level - 1 digits, by their next digit."""
    bounds = np.array([(prefix << RANGE_BITS | k) << (64 - RANGE_BITS * level) for k in range(1 << RANGE_BITS)], np.uint64)
    edge = [*np.searchsorted(hashes, bounds).tolist(), len(hashes)]
    return [(prefix << RANGE_BITS | k, slice(edge[k], edge[k + 1])) for k in range(1 << RANGE_BITS) if edge[k] < edge[k + 1]]


def _packs(source: int, wants: bool, items: np.ndarray, counts: list[np.ndarray], prefix: int = 0, level: int = 1) -> list[tuple]:
    return [(source, k, wants, pack_sorted(items[at]), *[pack(c[at]) for c in counts]) for k, at in cut(items, prefix, level)]


def _of_slice(number: int, kind: int, items: np.ndarray, own: np.ndarray):
    n = own * (kind != UNSEEN)
    return _batch(_packs(number, kind == DELETED, items, [n, n * (kind == RETAINED), np.ones(len(n), np.uint64)]), PACK)


def ask(slices: DataFrame) -> DataFrame:
    """Rows of PACK: each slice's different words and pairs with their counts in it, by range of hashes."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in ("slice", "kind", "words", "seq", "sizes")}
                s = Slice.of(one)
                yield _of_slice(one["slice"], one["kind"], s.items, s.own)
                del s
                give_back()

    return slices.select("slice", "kind", "words", "seq", "sizes").mapInArrow(run, PACK)


class Sums:
    """The different hashes of some packs with their counts added up, and where each pack's own ones are.

    n counts all training rows, kept the retained ones; slices are 1, or 2 where several slices have the hash.
    """

    def __init__(self, table):
        frame = {c: table.column(c).to_pylist() for c in ("source", "range", "wants", "items", "n", "kept", "slices")}
        self.sources, self.ranges, self.wants = frame["source"], frame["range"], frame["wants"]
        hashes = [unpack_sorted(x) for x in frame["items"]]
        self.ends = np.cumsum([0, *map(len, hashes)])
        self.items, self.place = np.unique(np.concatenate(hashes), return_inverse=True)
        add = lambda column: np.bincount(self.place, np.concatenate([unpack(x) for x in frame[column]]).astype(np.float64), len(self.items)).astype(np.uint64)
        self.n, self.kept, self.slices = add("n"), add("kept"), np.minimum(add("slices"), 2)

    def told(self, n: np.ndarray, kept: np.ndarray, slices: np.ndarray, vocabulary: int):
        """Rows of TOLD for each pack; the retained counts go to those who want them."""
        rows = []
        for i, (source, range_, wants) in enumerate(zip(self.sources, self.ranges, self.wants)):
            at = self.place[self.ends[i] : self.ends[i + 1]]
            rows.append((source, range_, wants, pack(n[at]), pack(kept[at] if wants else n[:0]), pack(slices[at]), 0 if i else vocabulary))
        import pyarrow as pa

        return pa.Table.from_batches([_batch(rows, TOLD)])


def totals(packs: DataFrame, sources: int, batch: int = BATCH, level: int = 1) -> DataFrame:
    """Rows of TOLD: for the hashes of each pack their counts in all training rows, and in the retained ones.

    `vocabulary` adds up to the number of different odd hashes (words) that were counted. A group holds at most
    about `batch` packs at each level, and there are about log(sources) / log(batch) levels.
    """
    if sources <= batch:

        def answer(table):
            give_back()
            sums = Sums(table)
            return sums.told(sums.n, sums.kept, sums.slices, int(((sums.items & _ONE == 1) & (sums.n > 0)).sum()))

        return packs.groupBy("range").applyInArrow(answer, TOLD)
    above = -(-sources // batch)
    packs = store(packs, "lm-packs").withColumn("batch", F.pmod(F.xxhash64("source"), F.lit(above)).cast("long"))

    def merge(key, table):
        import pyarrow as pa

        give_back()
        sums = Sums(table)
        wants = any(sums.wants)
        return pa.Table.from_batches([_batch(_packs(key[1].as_py(), wants, sums.items, [sums.n, sums.kept, sums.slices], key[0].as_py(), level + 1), PACK)])

    told = totals(packs.groupBy("range", "batch").applyInArrow(merge, PACK), above, batch, level + 1)
    answers = told.select(F.shiftright("range", RANGE_BITS).alias("range"), F.col("source").alias("batch"), F.col("range").alias("finer"), "n", "kept", "slices", "vocabulary")

    def pass_down(left, right):
        give_back()
        sums, right = Sums(left), right.sort_by("finer")
        n, kept, slices = (np.concatenate([unpack(x) for x in right.column(c).to_pylist()]) for c in ("n", "kept", "slices"))
        return sums.told(n, kept if len(kept) else n * np.uint64(0), slices, sum(right.column("vocabulary").to_pylist()))

    return packs.groupBy("range", "batch").cogroup(answers.groupBy("range", "batch")).applyInArrow(pass_down, TOLD)


def _told(table, stage: int, column: str) -> np.ndarray:
    """A slice's counts from all ranges, in the order of hashes."""
    import pyarrow.compute as pc

    own = table.filter(pc.equal(table.column("stage"), stage)).sort_by("range").column(column).to_pylist()
    return np.concatenate([unpack(x) for x in own]).astype(np.float64) if own else np.zeros(0)


def _elsewhere(table, s: Slice) -> np.ndarray:
    """Whether each pair of a slice stands in other slices too."""
    return _told(table, 1, "slices")[s.pair_at] > 1


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the power of two in the count."""
    return np.where(count > 0, np.frexp(np.maximum(count, 1).astype(np.float64))[1], 0)


class Model:
    """Sizes of the training rows; `pair` weighs bigram, unigram and uniform in each bucket, `triple` the trigram."""

    def __init__(self, vocabulary: int, tokens: int, texts: int, pair: np.ndarray, triple: np.ndarray):
        self.vocabulary, self.tokens, self.texts, self.pair, self.triple = vocabulary, tokens, texts, pair, triple

    def parts(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
        return [pair / np.maximum(context, 1), word / max(self.tokens, 1), np.full(len(pair), 1 / (self.vocabulary + 1))]

    def of_pairs(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """P(w | v) from the counts of (v, w), v and w."""
        return sum(w * p for w, p in zip(self.pair[bucket(context)].T, self.parts(pair, context, word)))

    def of_triples(self, triple: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P(w | u, v) from the counts of (u, v, w) and (u, v), and P(w | v)."""
        own = self.triple[bucket(context)]
        return own * triple / np.maximum(context, 1) + (1 - own) * lower


def learn(at: np.ndarray, value: np.ndarray, n: np.ndarray, possible: np.ndarray) -> np.ndarray:
    """Weights of each bucket by expectation-maximisation over cells: bucket, estimates relative to the last one, tokens.

    A bucket without deleted tokens has equal weights. What isn't `possible` weighs nothing.
    """
    prior = possible / possible.sum(axis=1, keepdims=True)
    weights = prior
    for _ in range(ROUNDS if len(at) else 0):
        share = weights[at] * value
        share *= (n / share.sum(axis=1))[:, None]
        # One token's worth of equal weights keeps every possible part above nothing.
        sums = np.stack([np.bincount(at, share[:, k], len(possible)) for k in range(possible.shape[1])], 1) + prior
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def steps(ratio: np.ndarray) -> np.ndarray:
    """Binary logarithms in whole steps."""
    return np.where(ratio > 0, np.round(np.log2(np.maximum(ratio, 1e-300)) / STEP), _NEVER).astype(np.int64)


def unstep(steps_: np.ndarray) -> np.ndarray:
    return np.where(steps_ <= _NEVER, 0.0, np.exp2(np.maximum(steps_, -4000) * STEP))


def learn_pairs(cells: np.ndarray, any_tokens: bool) -> np.ndarray:
    """From cells (bucket, steps of bigram and of unigram over uniform, tokens). A bigram whose context is unknown weighs nothing, and a unigram without any tokens."""
    possible = np.ones((BUCKETS, 3))
    possible[0, 0] = 0.0
    if not any_tokens:
        possible[:, :2] = 0.0
    return learn(cells[:, 0], np.stack([unstep(cells[:, 1]), unstep(cells[:, 2]), np.ones(len(cells))], 1), cells[:, 3], possible)


def learn_triples(cells: np.ndarray) -> np.ndarray:
    """From cells (bucket, steps of trigram over the bigram's mixture, tokens)."""
    possible = np.ones((BUCKETS, 2))
    possible[0, 0] = 0.0
    return learn(cells[:, 0], np.stack([unstep(cells[:, 1]), np.ones(len(cells))], 1), cells[:, 2], possible)[:, 0]


def _row(table) -> dict:
    return {c: table.column(c)[0].as_py() for c in ("kind", "words", "seq", "sizes")}


class Counted:
    """A slice with the counts told to it, of all training rows (column n) or of the retained ones (column kept)."""

    def __init__(self, row: dict, told, column: str, texts: int):
        self.s, self.texts, self.learned = Slice.of(row), texts, row["kind"] != UNSEEN
        self.told, self.column = told, column
        counts = _told(told, 1, column)
        self.word, self.pair = counts[self.s.word_at], counts[self.s.pair_at]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair its count, its context's and its last word's."""
        context = np.where(self.s.left < 0, self.texts, self.word[self.s.left]) if len(self.word) else np.zeros(0)
        return self.pair, context, self.word[self.s.right]

    def triples(self) -> tuple[Triples, np.ndarray, np.ndarray]:
        """The triples, their counts and their contexts'. First words have their pair's count and the number of texts."""
        t = Triples(self.s)
        chosen, _ = t.asked(self.s, _elsewhere(self.told, self.s))
        other = t.own * (self.learned and self.column == "n")
        count = t.counts(chosen, _told(self.told, 2, self.column), other, self.pair)
        return t, count, np.where(t.left >= 0, self.pair[t.left], self.texts)


def ask_triples(slices: DataFrame, told: DataFrame) -> DataFrame:
    """Rows of PACK: the triples of each slice whose counts its pairs don't tell."""

    def run(left, right):
        import pyarrow as pa

        give_back()
        row = _row(left)
        s = Slice.of(row)
        t = Triples(s)
        chosen, hashes = t.asked(s, _elsewhere(right, s))
        return pa.Table.from_batches([_of_slice(left.column("slice")[0].as_py(), row["kind"], hashes, t.own[chosen])])

    return _with_told(slices.select("slice", "kind", "words", "seq", "sizes"), told).applyInArrow(run, PACK)


def _with_told(slices: DataFrame, told: DataFrame):
    answers = told.select(F.col("source").alias("slice"), "stage", "range", "n", "kept", "slices")
    return slices.groupBy("slice").cogroup(answers.groupBy("slice"))


def _cells(counted, schema: str) -> np.ndarray:
    """Cells of the deleted rows' tokens; their number is bounded by the buckets and steps."""
    keys = [x.split()[0] for x in schema.split(", ")][:-1]
    rows = counted.groupBy(*keys).agg(F.sum("n").alias("n")).orderBy(*keys).toPandas()
    return rows.to_numpy(np.int64).reshape(-1, len(keys) + 1)


def _summed(columns: dict):
    import pandas as pd
    import pyarrow as pa

    cells = pd.DataFrame(columns)
    cells = cells.groupby([c for c in cells if c != "n"], as_index=False)["n"].sum()
    return pa.table({c: pa.array(cells[c], pa.int64()) for c in cells})


def pair_cells(deleted: DataFrame, told: DataFrame, sizes: Model) -> np.ndarray:
    def run(left, right):
        give_back()
        c = Counted(_row(left), right, "kept", sizes.texts)
        pair, context, word = c.pairs()
        two, one, zero = sizes.parts(pair, context, word)
        return _summed({"at": bucket(context), "two": steps(np.where(context > 0, two, 0.0) / zero), "one": steps(one / zero), "n": c.s.own_pair})

    schema = "at long, two long, one long, n long"
    return _cells(_with_told(deleted, told.where("wants")).applyInArrow(run, schema), schema)


def triple_cells(deleted: DataFrame, told: DataFrame, model: Model) -> np.ndarray:
    def run(left, right):
        give_back()
        c = Counted(_row(left), right, "kept", model.texts)
        lower = model.of_pairs(*c.pairs())
        t, count, context = c.triples()
        return _summed({"at": bucket(context), "three": steps(count / np.maximum(context, 1) / lower[t.last]), "n": t.own})

    schema = "at long, three long, n long"
    return _cells(_with_told(deleted, told.where("wants")).applyInArrow(run, schema), schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_tokens: int = SLICE_TOKENS, batch: int = BATCH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts have one token, the end. Rows with null ids are learned from. Repeated rows
    are counted and scored each. Without training rows every text is scored by the uniform estimate.
    Other columns of `docs` aren't read, whatever their names.
    """
    slices = store(slice_texts(docs.select(id_col, text_col), id_col, text_col, slice_tokens), "lm-slices")
    kinds = {r["kind"]: r for r in slices.groupBy("kind").agg(F.count("*").alias("slices"), F.sum(F.size("sizes")).alias("texts"), F.sum("n_tokens").alias("tokens")).collect()}
    whole = lambda what, *of: sum(kinds[k][what] for k in of if k in kinds)
    number = whole("slices", RETAINED, DELETED, UNSEEN)
    first = store(totals(ask(slices), number, batch), "lm-counts").withColumn("stage", F.lit(1))
    vocabulary = first.agg(F.coalesce(F.sum("vocabulary"), F.lit(0))).first()[0]
    second = store(totals(ask_triples(slices, first), number, batch), "lm-counts").withColumn("stage", F.lit(2))
    told = first.unionByName(second)
    deleted = slices.where(F.col("kind") == DELETED).select("slice", "kind", "words", "seq", "sizes")
    kept = Model(vocabulary, whole("tokens", RETAINED), whole("texts", RETAINED), np.zeros((BUCKETS, 3)), np.zeros(BUCKETS))
    pair = learn_pairs(pair_cells(deleted, first, kept), whole("tokens", RETAINED, DELETED) > 0)
    kept = Model(kept.vocabulary, kept.tokens, kept.texts, pair, kept.triple)
    triple = learn_triples(triple_cells(deleted, told, kept))
    model = Model(vocabulary, whole("tokens", RETAINED, DELETED), whole("texts", RETAINED, DELETED), pair, triple)

    def run(left, right):
        import pyarrow as pa

        give_back()
        row = _row(left)
        c = Counted(row, right, "n", model.texts)
        sizes, first_token = c.s.sizes, c.s.first
        sums = lambda v: np.add.reduceat(v, first_token)
        base = sums(np.log10((c.word + 1) / (model.tokens + model.vocabulary + 1))[c.s.seq])
        known = sums((c.word > 0)[c.s.seq].astype(np.int64))
        lower = model.of_pairs(*c.pairs())
        t, count, context = c.triples()
        log = np.log10(model.of_triples(count, context, lower[t.last]))
        same = lambda value: np.full(len(sizes), value)
        columns = {"held_out": same(row["kind"] == UNSEEN), "n_tokens": sizes, "n_known": known, "train_tokens": same(model.tokens), "base_score": base, "score": sums(log[t.token])}
        return pa.table({"doc_id": left.column("names").combine_chunks().flatten(), **{k: pa.array(v) for k, v in columns.items()}})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_told(slices.select("slice", "kind", "names", "words", "seq", "sizes"), told).applyInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Per document its tokens, the base score and the model's."""
    return score(docs)
