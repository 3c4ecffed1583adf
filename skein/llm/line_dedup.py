"""Line deduplication with suffix ranks over line ids.

A line is deleted if it lies in a run of consecutive lines of one document, of at least `min_words`
words together, that also stands at an earlier place. Places are ordered by document id (null first),
then line; the first copy stays.

Lines that stand once end every repeated run, so only islands of repeated lines go on, and only those of
enough words. Over these, prefix doubling ranks all places by their next 1, 2, 4, ... line ids: at each
step the different pairs of ranks are counted (with map-side combine), sorted by range and numbered
by prefix sums, which gives each place its suffix-array rank to that depth. An interval of suffixes that share l
lines is told by two overlapping ranks of the largest power of two within l. For every place the shortest runs of
enough words from it and up to it are looked up; all but the first place of each interval lose
their lines. Every maximal repeated run is the union of such runs, so nothing longer need be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm._work import settle
from skein.llm.prefix_sums import numbered

#: Words that a repeated run has at least.
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
DOC = ["doc", "digest"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(text: Column) -> Column:
    """Tells rows of one id apart; rows that agree in id and text are one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def islands(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Places of repeated lines in islands of enough words.

    doc, digest, line, island, h1 and h2 (two 64-bit hashes, the line's id), words, before (words of the
    island before the line), total (words of the island) and stop (the line after the island).
    """
    source = docs.select(F.col(id_col).alias("doc"), _digest(F.col(text_col)).alias("digest"), F.posexplode(_lines(F.col(text_col))).alias("line", "content"))
    ids = [F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), F.col("content")).alias("h2")]
    often = settle(source.select(*ids).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    words = F.regexp_count("content", F.lit(WORD)).cast("long")
    places = source.select(*DOC, "line", *ids, words.alias("words")).join(often, ["h1", "h2"])
    own = Window.partitionBy(*DOC).orderBy("line")
    # Rows that are one document put their lines at the same places.
    places = places.withColumn("copy", F.row_number().over(own) - F.rank().over(own)).where("copy = 0")
    places = places.withColumn("island", F.col("line") - F.row_number().over(own))
    whole = Window.partitionBy(*DOC, "island")
    before = F.sum("words").over(whole.orderBy("line")) - F.col("words")
    places = places.withColumns({"before": before, "total": F.sum("words").over(whole), "stop": F.max("line").over(whole) + 1})
    return settle(places.where(F.col("total") >= min_words))


def windows(places: DataFrame, min_words: int) -> DataFrame:
    """doc, digest, line and size of the shortest runs of enough words from each line, and up to each line."""
    whole = Window.partitionBy(*DOC, "island")
    after = F.min("line").over(whole.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing))
    ahead = F.coalesce(after, F.when(F.col("total") - F.col("before") >= min_words, F.col("stop"))) - F.col("line")
    upto = F.col("before") + F.col("words")
    last = F.max("line").over(whole.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    begin = F.coalesce(last + 1, F.when(F.col("upto") >= min_words, F.min("line").over(whole)))
    both = places.withColumn("upto", upto).withColumns({"ahead": ahead, "begin": begin})
    runs = F.array(F.struct(F.col("line").alias("at"), F.col("ahead").alias("size")), F.struct(F.col("begin").alias("at"), (F.col("line") + 1 - F.col("begin")).alias("size")))
    return both.select(*DOC, F.inline(runs)).where("at is not null and size is not null").select(*DOC, F.col("at").alias("line"), "size")


def ranked(places: DataFrame, keys: list[str]) -> DataFrame:
    """Places with their rank by `keys`; those whose keys stand once, or have a null, go."""
    classes = places.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    ranks = settle(numbered(classes, keys).where("n > 1").select(*keys, "rank"))
    return settle(places.join(ranks, keys).select(*DOC, "line", "island", "rank"))


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc, digest and `removed`, the line numbers to delete, of every document that loses any.

    Null texts have no lines; an empty text has one empty line.
    """
    places = islands(docs, id_col, text_col, min_words)
    runs = settle(windows(places, min_words).withColumn("level", F.floor(F.log2(F.col("size").cast("double")) + 1e-9).cast("int")).distinct())
    deepest = runs.agg(F.max("level")).first()[0]
    found = None
    place = ranked(places, ["h1", "h2"])
    for level in range((-1 if deepest is None else deepest) + 1):
        step = 1 << level
        rank = lambda name, line: place.select(*DOC, F.col("line").alias(line), F.col("rank").alias(name))  # noqa: B023, E731
        own = runs.where(F.col("level") == level).withColumn("end", F.col("line") + F.col("size") - step)
        own = _looked_up(own, rank("head", "line"), "line")
        own = _looked_up(own, rank("tail", "end"), "end").select(*DOC, "line", "size", "head", "tail")
        found = own if found is None else found.unionByName(own)
        if level < deepest:
            ahead = Window.partitionBy(*DOC, "island").orderBy("line").rangeBetween(step, step)
            place = ranked(place.withColumnRenamed("rank", "head").withColumn("tail", F.max("head").over(ahead)), ["head", "tail"])
    if found is None:
        return places.select(*DOC, F.array("line").alias("removed")).limit(0)
    found = settle(found.withColumn("place", F.struct(*DOC, "line")))
    key = ["size", "head", "tail"]
    first = settle(found.groupBy(*key).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = found.join(first, key).where(F.col("place") > F.col("first"))
    lines = copies.select(*DOC, F.explode(F.sequence("line", F.col("line") + F.col("size") - 1)).alias("line"))
    return lines.groupBy(*DOC).agg(F.array_sort(F.collect_set("line")).alias("removed"))


def _looked_up(runs: DataFrame, ranks: DataFrame, line: str) -> DataFrame:
    """`runs` with the rank of a place; runs whose place has none go."""
    ranks = ranks.withColumnsRenamed({"doc": "doc_", "digest": "digest_", line: "line_"})
    same = F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("digest") == F.col("digest_")) & (F.col(line) == F.col("line_"))
    return runs.join(ranks, same).drop("doc_", "digest_", "line_")


def with_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of `docs` with `removed`, the numbers of the lines to delete, from 0.

    Rows that agree in id and text are one document and lose the same lines. A column named removed is replaced.
    """
    base = docs.drop("removed")
    gone = later_copies(base, id_col, text_col, min_words).withColumnsRenamed({"doc": "_doc", "digest": "_digest"})
    same = F.col(id_col).eqNullSafe(F.col("_doc")) & (_digest(F.col(text_col)) == F.col("_digest"))
    none = F.array().cast("array<int>")
    return base.join(gone, same, "left").withColumn("removed", F.coalesce("removed", none)).select(*base.columns, "removed")


def kept_text(text_col: str = "text") -> Column:
    """The text without the lines in `removed`; null stays null, and a text that loses all its lines is empty."""
    lines = F.filter(_lines(F.col(text_col)), lambda _, i: ~F.array_contains("removed", i))
    return F.when(F.size("removed") == 0, F.col(text_col)).otherwise(F.array_join(lines, "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` with later copies of repeated runs of lines cut out of their texts."""
    return with_removed(docs, id_col, text_col, min_words).withColumn(text_col, kept_text(text_col)).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Per document its lines, the lines deleted and a digest of what is kept."""
    found = with_removed(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
        F.sha2(F.coalesce(kept_text(), F.lit("")), 256).alias("kept_sha256"),
    )
