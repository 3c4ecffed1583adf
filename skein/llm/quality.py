"""Quality classifier with naive Bayes support vectors.

Features are indicators of n-grams, hashed into a table of fixed size: runs of letters and of marks (one and
two of them) and the shapes of such runs (one to three; a run's shape tells whether it repeats the one or two before). Indicators are scaled by the log-count ratio of the two
classes, and a linear hinge-loss model is fitted by dual coordinate descent. It is fitted on a bounded
sample of the labelled rows, and its weights, a table of fixed size, are broadcast; every row is scored
where it is read. Only the texts and the labels' `quality` are used, and never a held-out label.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import _text
from skein.llm._work import give_back

#: Labelled rows that the model is fitted on at most, the smallest by a hash of their ids.
TRAIN_ROWS = 8000
#: Binary logarithm of the number of features.
BITS = 18
#: Texts are turned into features in slices of about this many bytes: a slice's arrays fit a processor's caches.
PART_BYTES = 1 << 18
#: Of the sample, one row in so many sets the scale of the scores instead of the weights.
SCALE_PART = 4
PENALTY = 1.0
EPOCHS = 12
ADDED = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

_WORD = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])
_MARK = np.array([0x20 < c < 0x7F and not chr(c).isalnum() for c in range(256)])
_SHAPE = np.array([65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c if _MARK[c] else 97 for c in range(256)], np.uint64)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different feature numbers of each text, one text after the other, and where each text's begin."""
    empty = np.zeros(0, np.int64)
    words, marks = _text.Words(texts, _WORD, lower=False), _text.Words(texts, _MARK, lower=False)
    starts = np.concatenate([words.starts, marks.starts])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([words.ends, marks.ends])[order]
    if not len(starts):
        return empty, np.zeros(len(texts) + 1, np.int64)
    text = np.searchsorted(words.text_start, starts, "right") - 1
    run = _text.hash_spans(words.buf, starts, ends)
    size = np.minimum(ends - starts, 4).astype(np.uint64)
    again = np.zeros(len(run), np.uint64)
    for back in (1, 2):  # only within a text: no feature depends on its neighbours
        again[back:] |= (run[back:] == run[:-back]) & (text[back:] == text[:-back])
    shape = (_SHAPE[words.buf[starts]] * np.uint64(256) + _SHAPE[words.buf[ends - 1]]) * np.uint64(16) + size * np.uint64(2) + again
    keys, owners = [], []
    for kind, (values, longest) in enumerate(((run, 2), (shape, 3))):
        gram = values
        for n in range(1, longest + 1):
            if n > 1:
                gram = _text.mix(gram[: len(values) - n + 1] * np.uint64(31)) + values[n - 1 :]
            if not len(gram):
                break
            whole = text[: len(gram)] == text[n - 1 :]
            keys.append(_text.mix(gram[whole] ^ np.uint64(1 + 2 * n + 16 * kind)) >> np.uint64(64 - BITS))
            owners.append(text[: len(gram)][whole])
    both = np.unique(np.concatenate(owners) << BITS | np.concatenate(keys).astype(np.int64))
    first = np.searchsorted(both >> BITS, np.arange(len(texts) + 1))
    return both & ((1 << BITS) - 1), first


class Model:
    """Weights of all features, and the scale that turns margins into scores."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, offset: float):
        self.ratio, self.weight, self.bias, self.slope, self.offset = ratio, weight, bias, slope, offset

    def margins(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        sums = lambda v: np.bincount(owner, v, len(first) - 1)  # noqa: E731  each text from zero on, so that no sum depends on its neighbours
        norm = np.sqrt(sums(self.ratio[index] ** 2))
        return sums((self.ratio * self.weight)[index]) / np.maximum(norm, 1e-9) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.slope * self.margins(*features(texts)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def constant(labels: np.ndarray) -> Model:
    """Where a class is missing: the share of label 1, drawn towards one half, for every text."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))


def fit_rows(flat: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Model:
    """Fit on rows of feature numbers, row k from first[k] on: ratios, dual coordinate descent, then the scale on rows set aside."""
    aside = np.arange(len(labels)) % SCALE_PART == SCALE_PART - 1
    if len(set(labels[~aside])) < 2 or len(set(labels[aside])) < 2:
        return constant(labels)
    row = lambda k: flat[first[k] : first[k + 1]]
    count = np.ones((2, 1 << BITS))
    for k in np.flatnonzero(~aside):
        count[labels[k]][row(k)] += 1
    share = count / count.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    weight, bias = np.zeros(1 << BITS), 0.0
    own = np.flatnonzero(~aside & (np.diff(first) > 0))
    norm = {k: max(np.linalg.norm(ratio[row(k)]), 1e-9) for k in own.tolist()}
    sign = np.where(labels == 1, 1.0, -1.0)
    amount = np.bincount(labels[own], minlength=2)
    bound = PENALTY * len(own) / (2 * np.maximum(amount, 1))  # both classes weigh the same
    alpha = np.zeros(len(labels))
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in rng.permutation(own).tolist():
            features = row(k)
            values = ratio[features] / norm[k]
            margin = sign[k] * (weight[features] @ values + bias)
            new = min(max(alpha[k] - (margin - 1) / 2.0, 0.0), bound[labels[k]])  # the row and the bias have norm 1 each
            if new != alpha[k]:
                step = (new - alpha[k]) * sign[k]
                weight[features] += step * values
                bias += step
                alpha[k] = new
    model = Model(ratio, weight, bias, 1.0, 0.0)
    z = np.array([model.margins(row(k), np.array([0, first[k + 1] - first[k]]))[0] for k in np.flatnonzero(aside)])
    model.slope, model.offset = logistic(z, labels[aside])
    return model


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, targets drawn slightly towards one half."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (t - p) - 1e-3 * a)
        a = a + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return float(a[0]), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `train_rows` labelled rows that aren't held out, those with the smallest hashes of their ids.

    A repeated label or document is a row each time; rows with null labels, labels other than 0 and 1, or null ids are
    left out. Null texts count as empty. Where a class has no rows every text gets the same score.
    """
    own = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    sample = own.select(id_col, F.col("quality").cast("int").alias("_y")).orderBy(F.xxhash64(id_col), id_col, "_y").limit(train_rows)
    # The sample has at most train_rows rows of two numbers, so its size is bounded.
    texts = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(F.xxhash64(id_col).alias("k"), "_y", text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in _text.sliced(batch, text_col, PART_BYTES):
                index, first = features(texts)
                rows = [index[first[i] : first[i + 1]].astype(np.uint32).tobytes() for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("_y"), pa.array(rows, pa.binary())], ["k", "y", "rows"])

    found = texts.mapInArrow(run, "k long, y int, rows binary").orderBy("k", "y", "rows").limit(train_rows).toArrow()
    y = found.column("y").to_numpy().astype(np.int64)
    if not len(y):
        return constant(y)
    column = found.column("rows").combine_chunks()
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(y) + 1]
    # One flat array of all rows' features, without an object for each row.
    return fit_rows(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint32), (ends - ends[0]).astype(np.int64) // 4, y)


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` with score (0 to 1) and predicted (1 from one half on).

    Null texts count as empty. Columns named score or predicted are replaced.
    """
    base = docs.drop(*[f.name for f in ADDED])
    names = base.columns
    # Plain arrays: workers have no copy of this module's classes.
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.weight, model.bias, model.slope, model.offset))

    def run(batches):
        import pyarrow as pa

        model = Model(*shared.value)
        for batch in batches:
            for part, texts in _text.sliced(batch, text_col, PART_BYTES):
                score = model.scores(texts)
                added = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *added], [*names, "score", "predicted"])
                del part, texts
            del batch
            give_back()

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *ADDED]))


def keep_good(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None) -> DataFrame:
    """The rows that the classifier doesn't reject, with their own columns."""
    model = fit(training_docs if training_docs is not None else docs, labels)
    return with_score(docs, model).where("predicted = 1").select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document whether its label is held out, its score and the prediction."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
