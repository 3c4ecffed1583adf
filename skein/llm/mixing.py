"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slots are numbered; slot i draws the golden-ratio point frac(i * phi), which falls into one source's
share of the cumulated targets. The slots of a source are ranked, and its r-th slot takes the r-th block of
equally many words of the source's documents in shuffled order, starting again at the end. A source that
draws fewer slots than its target has blocks gets the missing ones after its last. Ranks and word
offsets are prefix sums of two levels: sums per range, then rows within a range, so that a source
with a third of all rows is never in one task.

The order of a source's documents is that of an md5 of id and text, so it doesn't depend on where rows are read. Rows
that agree in id, source and text are one entry with a number of copies, and share what is taken of it evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm._text import SOLID_WORD
from skein.llm._work import each_copy, settle

PHI = 0.6180339887498949
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words the mix takes in all, as a part of all words; and at most of one source.
SHARE, LIMIT = 1.5, 2.0
#: Words of a block.
BLOCK_WORDS = 1024
#: Up to so many sources the table of sources is broadcast, beyond them it is shuffled.
BROADCAST_SOURCES = 10_000
#: Cells of the unit interval by which points are joined to the sources' shares.
CELLS = 4096
#: Slots and documents in one range of a two-level prefix sum, about.
RANGE = 4096


def size_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SOLID_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target: weighted shares of `share` times all words, none above `limit` times its source.

    Sources stop at their limit in the order of limit over weight; each is stopped if the level
    that the rest would have without it is no lower than its own. Sources sort by code point, null last.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumns({"rank": rank, "w": weight}).withColumn("cap", limit * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left)
    stopped = F.col("cap") <= F.col("level") * F.col("w")
    per = per.withColumn("stopped", stopped)
    # Past the first source that isn't stopped the levels fall; that first one is the level of the rest.
    level = F.max(F.when(~F.col("stopped"), F.col("level"))).over(every)
    return per.select("source", "rank", "source_size", F.when(F.col("stopped"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def schedule(spark, shares: DataFrame, slots: int) -> DataFrame:
    """rank (of the source) and r: the source of each slot and its number among the source's slots, from 0."""
    order = Window.orderBy("rank")
    total = F.sum("target").over(Window.partitionBy())
    high = F.sum("target").over(order) / total
    bounds = shares.where("target > 0").select("rank", (high - F.col("target") / total).alias("low"), high.alias("high"), F.row_number().over(Window.orderBy(F.col("rank").desc())).alias("back"))
    bounds = bounds.withColumn("high", F.when(F.col("back") == 1, F.lit(2.0)).otherwise(F.col("high")))
    last = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))
    cells = bounds.select("rank", "low", "high", F.explode(F.sequence(F.greatest(F.floor(F.col("low") * CELLS) - 1, F.lit(0)), last)).alias("cell"))
    point = F.col("id") * F.lit(PHI) - F.floor(F.col("id") * F.lit(PHI))
    points = spark.range(slots).select("id", point.alias("u")).withColumn("cell", F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1)))
    drawn = points.join(cells, "cell").where("u >= low and u < high").select("rank", "id", F.floor(F.col("id") / RANGE).alias("range"))
    return _numbered(drawn, ["rank"], "range", ["id"], F.lit(1), "r").select("rank", "r")


def filled(drawn: DataFrame, shares: DataFrame, block: int) -> DataFrame:
    """The drawn slots (rank, r) and, of each source, those missing up to the blocks of its target."""
    counts = drawn.groupBy("rank").agg(F.count("*").alias("n"))
    wanted = shares.select("rank", F.ceil(F.floor("target") / block).cast("long").alias("wanted")).join(counts, "rank", "left")
    n = F.coalesce("n", F.lit(0))
    return drawn.unionByName(wanted.where(n < F.col("wanted")).select("rank", F.explode(F.sequence(n, F.col("wanted") - 1)).alias("r")))


def _numbered(rows: DataFrame, group: list[str], range_col: str, order: list, amount: Column, out: str) -> DataFrame:
    """Adds the sum of `amount` over the rows before, within `group`: of earlier ranges, then of the row's range."""
    sums = rows.groupBy(*group, range_col).agg(F.sum(amount).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(range_col).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, range_col, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, range_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(sums, [*group, range_col]).withColumn(out, F.col("_before") + F.col("_in")).drop("_in", "_before")


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, order, size and copies: rows that agree in id, source and text are one entry."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), "source", order.alias("order"), size_of(F.col(text_col)).alias("size"))
    return rows.groupBy("doc_id", "source", "order", "size").agg(F.count("*").alias("copies"))


def mix(rows: DataFrame, block_words: int = BLOCK_WORDS, share: float = SHARE, limit: float = LIMIT, weights: tuple = WEIGHTS) -> DataFrame:
    """Adds source_size, target and taken to rows of (doc_id, source, order, size, copies).

    taken counts words of all copies, repeats too: at most `limit` times the size of each. Rows without words take
    none. A null source is a source of its own. An empty table stays empty.
    """
    spark = rows.sparkSession
    rows = settle(rows)
    shares = settle(targets(rows.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, share, limit))
    slots = shares.agg(F.coalesce(F.sum(F.ceil(F.col("target") / block_words)), F.lit(0)).alias("n")).first()["n"]
    taken = filled(schedule(spark, shares, slots), shares, block_words)
    ranges = max(1, rows.count() // RANGE)
    small = shares.count() <= BROADCAST_SOURCES
    named = rows.join(F.broadcast(shares) if small else shares, rows["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    # Ranges follow the order, so that their number changes no result.
    named = settle(named.withColumn("range", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * ranges, 32)))
    some = _numbered(named.where("size > 0"), ["rank"], "range", ["order", "doc_id"], F.col("size") * F.col("copies"), "start")
    # A source's words stand several times in a row; blocks past its target are nobody's.
    stop = F.floor("target").cast("long")
    begin = F.col("start") + F.col("epoch") * F.col("source_size")
    epochs = F.explode(F.sequence(F.lit(0), F.lit(-int(-limit // 1) - 1)))
    key = ["rank", "doc_id", "order"]
    some = some.select(*key, (F.col("size") * F.col("copies")).alias("size"), stop.alias("stop"), epochs.alias("epoch"), "start", "source_size")
    some = some.select(*key, "stop", begin.alias("a"), F.least(begin + F.col("size"), F.col("stop")).alias("b")).where("a < b")
    pieces = some.withColumn("r", F.explode(F.sequence(F.floor(F.col("a") / block_words), F.floor((F.col("b") - 1) / block_words))))
    words = F.least("b", (F.col("r") + 1) * block_words) - F.greatest("a", F.col("r") * block_words)
    got = pieces.select(*key, "r", words.alias("words")).join(taken, ["rank", "r"]).groupBy(*key).agg(F.sum("words").alias("taken"))
    got = settle(got).withColumnsRenamed({"rank": "_rank", "doc_id": "_id", "order": "_order"})
    same = (F.col("rank") == F.col("_rank")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("order") == F.col("_order"))
    return named.join(got, same, "left").select(*rows.columns, "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes of it."""
    each = each_copy(mix(entries(docs)), "copies", "copy")
    taken = F.floor(F.col("taken") / F.col("copies")) + (F.col("copy") < F.col("taken") % F.col("copies")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: each as often as its taken words fill it, rounded.

    A document without words stays once. Rows that agree in id, source and text each stand equally often. Other
    columns are kept, whatever their names; null ids, sources and texts are values like any other.
    """
    found = mix(entries(docs), **options)
    often = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.greatest(F.col("size") * F.col("copies"), F.lit(1)))).cast("int")
    # Written, so that both sides of the join are plain exchanges, of which a skewed part can be split.
    per = settle(found.select(F.struct("doc_id", "source", "order").alias("_key"), often.alias("_often")).where("_often > 0"))
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.struct("doc_id", "source", order.alias("order")).alias("_own"))
    joined = keyed.join(per, F.col("_own").eqNullSafe(F.col("_key")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_often"))).alias("_copy")).select("_row.*")
