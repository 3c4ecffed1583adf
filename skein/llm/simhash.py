"""SimHash near-duplicates: 64-bit fingerprints compared exactly in tiles.

Fingerprints are made where the rows are read. Distinct ones are dealt into tiles: a link of
`radius` bits leaves at least lanes - radius of the lanes untouched, so two linked fingerprints
share the value of some set of that many lanes, and a tile is such a set and value. A tile above
`tile_rows` fingerprints is cut further by population count and a salt, and pairs of these smaller
tiles meet only where their population counts differ by at most the radius. Inside a task, tiles are
compared with exclusive-or and bit counts, again only across population counts within the radius.
Every link of different fingerprints is found; each pair of tiles returns a spanning forest of its links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import _text
from skein.llm._work import give_back, settle
from skein.llm.components import components

RADIUS = 3
LANES = 5
SHINGLE = 3
SEED = 42
TILE_ROWS = 4096
#: Rows of tiles that one task compares, about; fewer where there are fewer rows than tasks to run.
PART_ROWS = 100_000

# Byte value -> eight bytes, each one bit of it, lowest first.
_SPREAD = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    hashes, sizes = [], []
    for text in texts:
        words = text.translate(_text.ASCII_LOWER).split()
        if len(words) <= shingle:
            own = [b" ".join(words)] if words else []
        else:
            own = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        before = len(hashes)
        hashes.extend([xxh64_intdigest(x, seed) for x in own])
        sizes.append(len(hashes) - before)
    size = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    bits = _SPREAD[np.array(hashes, np.uint64).view(np.uint8)].reshape(-1, 8)
    # Byte-wide counters hold 255 hashes, so that longer texts are summed in parts.
    first = np.cumsum(size) - size
    parts = -(-size // 255)
    owner = np.repeat(np.arange(len(size)), parts)
    start = np.repeat(first, parts) + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    sums = np.add.reduceat(bits, start, axis=0).view(np.uint8).astype(np.int64)
    filled = np.flatnonzero(size)
    total = np.add.reduceat(sums, (np.cumsum(parts) - parts)[filled], axis=0)
    chosen = 2 * total > size[filled, None]
    out[filled] = np.packbits(chosen, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """`docs` without the text and with its fingerprint as a signed long; null texts count as empty."""
    kept = [c for c in docs.columns if c not in (text_col, out_col)]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out_col, T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in _text.sliced(batch, text_col):
                fp = fingerprints(texts).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(fp)], [*kept, out_col])
                del part, texts
            del batch
            give_back()

    return docs.select(*kept, text_col).mapInArrow(run, schema)


def lane_keys(lanes: int, radius: int) -> list[tuple[int, int]]:
    """(set number, bit mask) of every set of lanes - radius lanes."""
    edges = [64 * k // lanes for k in range(lanes + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(lanes)]
    return [(i, sum(masks[k] for k in some)) for i, some in enumerate(combinations(range(lanes), lanes - radius))]


def _roots(parent: np.ndarray) -> np.ndarray:
    """Each node's smallest known ancestor."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def forest(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Pairs that connect all that the links between x and y connect: each value with the smallest of its component.

    Tiles are sorted by population count and compared where these counts allow. A tile's links are hooked into the
    array of parents all at once, the larger root below the smaller one, until no link joins two roots.
    """
    values, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    at_x, at_y = place[: len(x)], place[len(x) :]
    px, py = np.bitwise_count(x).astype(np.int64), np.bitwise_count(y).astype(np.int64)
    ox, oy = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
    x, at_x, px, y, at_y, py = x[ox], at_x[ox], px[ox], y[oy], at_y[oy], py[oy]
    parent = np.arange(len(values))
    step = 256
    for a in range(0, len(x), step):
        lo = np.searchsorted(py, px[a] - radius, "left")
        hi = np.searchsorted(py, px[min(a + step, len(x)) - 1] + radius, "right")
        for b in range(lo, hi, 4 * step):
            i, j = np.nonzero(np.bitwise_count(x[a : a + step, None] ^ y[None, b : min(b + 4 * step, hi)]) <= radius)
            i, j = at_x[a + i], at_y[b + j]
            while len(i):
                u, v = parent[i], parent[j]
                apart = u != v
                if not apart.any():
                    break
                i, j, u, v = i[apart], j[apart], u[apart], v[apart]
                np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
                parent = _roots(parent)
    below = np.flatnonzero(parent != np.arange(len(values)))
    return np.stack([values[below], values[parent[below]]], 1)


def links(distinct: DataFrame, radius: int = RADIUS, lanes: int = LANES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links of different fingerprints, enough of them to keep all that are connected connected."""
    keys = F.array(*[F.struct(F.lit(i).alias("lane"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in lane_keys(lanes, radius)])
    dealt = distinct.select("fp", F.inline(keys))
    tiles = dealt.groupBy("lane", "value").agg(F.count("*").alias("n")).where("n > 1")
    cut = F.ceil(F.col("n") / tile_rows).cast("int")
    rows = dealt.join(tiles, ["lane", "value"]).withColumn("cuts", cut)
    small = rows.where("cuts = 1").select("lane", "value", F.lit("").alias("pair"), F.lit(0).alias("side"), "fp")
    # Large tiles: one smaller tile per population count and salt; each row goes to its pairs.
    salt = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    large = rows.where("cuts > 1").withColumn("p", F.bit_count("fp").cast("int")).withColumn("s", salt)
    near = F.explode(F.sequence(F.greatest(F.col("p") - radius, F.lit(0)), F.least(F.col("p") + radius, F.lit(64))))
    large = large.withColumn("q", near).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    mine, other = F.struct(F.col("p").alias("p"), F.col("s").alias("s")), F.struct(F.col("q").alias("p"), F.col("t").alias("s"))
    pair = F.to_json(F.array(F.least(mine, other), F.greatest(mine, other)))
    large = large.select("lane", "value", pair.alias("pair"), (mine > other).cast("int").alias("side"), "fp")

    def compare(key, frame):
        import pandas as pd

        values = frame["fp"].to_numpy().view(np.uint64)
        side = frame["side"].to_numpy()
        left, right = values[side == 0], values[side == 1]
        found = forest(left, left if key[2] == "" or _same(key[2]) else right, radius)
        return pd.DataFrame(found.reshape(-1, 2).view(np.int64), columns=["a", "b"])

    size = tiles.agg(F.coalesce(F.sum(F.col("n") * F.col("n") / F.least(F.col("n"), F.lit(tile_rows))), F.lit(0.0))).first()[0]
    tasks = 2 * distinct.sparkSession.sparkContext.defaultParallelism
    return _grouped(small.unionByName(large), compare, max(tasks, int(size // PART_ROWS) + 1))


def _same(pair: str) -> bool:
    import json

    a, b = json.loads(pair)
    return a == b


def _grouped(rows: DataFrame, compare, parts: int) -> DataFrame:
    """Whole groups in whole partitions: many groups share one Python call."""

    def run(frames):
        import pandas as pd

        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            mark = frame[["lane", "value", "pair"]]
            change = (mark != mark.shift()).any(axis=1).to_numpy().nonzero()[0]
            last = change[-1]
            yield from _compared(frame.iloc[:last], change[:-1], compare)
            rest = frame.iloc[last:]
        if rest is not None and len(rest):
            yield from _compared(rest, np.array([0]), compare)

    # A fixed number of parts: by their bytes alone the small rows of all tiles would be merged into one task.
    keyed = rows.repartition(parts, "lane", "value", "pair").sortWithinPartitions("lane", "value", "pair")
    return keyed.mapInPandas(run, "a long, b long")


def _compared(frame, starts, compare):
    import pandas as pd

    bounds = [*starts.tolist(), len(frame)]
    found = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        part = frame.iloc[a:b]
        found.append(compare((part["lane"].iat[0], part["value"].iat[0], part["pair"].iat[0]), part))
    if found:
        yield pd.concat(found, ignore_index=True)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _named(prints: DataFrame, least: "F.Column", radius: int, tile_rows: int) -> DataFrame:
    """fp and `least` over all rows that its links reach."""
    distinct = settle(prints.groupBy("fp").agg(least.alias("least")))
    roots = components(links(distinct.select("fp"), radius, tile_rows=tile_rows))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = member.groupBy("root").agg(F.min("least").alias("least"))
    # Written, so that joins with it have plain exchanges on both sides and the rows of a very common fingerprint can be split.
    return settle(member.select("fp", "root").join(whole, "root").select(F.col("fp").alias("_fp"), "least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row of `docs`: id, fp (signed long) and component_id.

    component_id is the smallest id of all rows whose fingerprints are reachable by links of at most
    `radius` bits. Rows with null ids take part but never name a component that has any other id.
    Texts without words have fingerprint zero, linked like any other. Repeated rows stay repeated.
    """
    prints = settle(with_fingerprint(docs.select(id_col, text_col), text_col))
    named = _named(prints, F.min(id_col), radius, tile_rows)
    return prints.join(named, F.col("fp") == F.col("_fp")).select(id_col, "fp", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: that with the smallest id (null last), then the smallest text hash.

    Rows are told apart by id and text, so other texts under the same id are kept or dropped on their own. Of rows
    that agree in both, one stays, that with the smallest hash of all columns. Other columns are kept, whatever their names.
    """
    id_, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    own = [F.xxhash64(F.lit(k), id_.isNull(), id_, text).alias(f"h{k}") for k in (1, 2)]
    keyed = docs.select(*own, F.struct(*docs.columns).alias("_row"))
    # The same rows are one from each task before they are shuffled; the join needs no other shuffle of the texts.
    whole = F.xxhash64(*[F.col("_row")[f.name] for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)])
    one = keyed.groupBy("h1", "h2").agg(F.min_by("_row", whole).alias("_row"))
    key = F.struct(id_.isNull().alias("none"), id_.alias("id"), *own)
    prints = settle(with_fingerprint(docs.select(key.alias("key"), F.col(text_col).alias("text"))))
    kept = _named(prints, F.min("key"), radius, tile_rows).select("least.h1", "least.h2").distinct()
    return one.join(kept, ["h1", "h2"], "left_semi").select("_row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
