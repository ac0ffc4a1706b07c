"""Line dedup by a suffix array over line ids. DataFrame functions only.

Every line is a symbol, named by 128 bits of hash, and every document a sequence of them. Prefix doubling ranks all
suffixes by their first line, then by their first two, four and so on: a suffix's next rank is that of the pair of its
rank and the rank of the suffix ``depth`` lines further. Ranks are given to distinct pairs: these are sorted by range,
numbered inside each range, and each range starts where the one before ends. A suffix whose rank nobody shares has no
equal up to that depth and leaves; so do those that would need it as their second half. Most text is gone after
the first round.

Suffixes of one rank are an interval of the suffix array whose longest common prefix is at least the depth. All but its
first suffix, by document and line, are later copies. A repeated run counts, and its later copies are deleted, if it has
``MIN_LINES`` lines or ``MIN_WORDS`` words. So intervals of every depth up to ``MIN_LINES`` are looked at: those below it by
their words, which are the same all over an interval. Whatever repeats further is made of runs of ``MIN_LINES`` lines
that repeat, each of which begins at a later copy of its own, so their union is the maximal repeated run from its first line to
its last, however long, and deeper intervals would delete nothing more.

Defined results: null and empty texts have one empty line. Blank lines are lines. Repeats inside a document count like
those across. Rows that agree in doc_id and text are one document. A null doc_id comes first. Documents of one or two
lines lose what counts by its words. Lines of any length are whole. Extra columns are left out, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.common import stored

MIN_LINES = 3
MIN_WORDS = 50
NO_ID = -(1 << 63)
BLANKS = r"[\x20\x09-\x0D]+"


def line_rows(docs: DataFrame) -> DataFrame:
    """``(id, text_hash, line, words, a, b)``: each line of each document, its words, and its name, two hashes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    lines = rows.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line", "value"))
    words = F.size(F.array_remove(F.split("value", BLANKS), ""))
    return lines.select(
        "id", "text_hash", "line", words.alias("words"), F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), "value").alias("b")
    )


def ranked(pairs: DataFrame) -> DataFrame:
    """``(a, b, rank)`` of the distinct pairs that more than one suffix has.

    Ranges of pairs are sorted apart; a row per range tells where each begins.
    """
    shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    ranges = stored(shared.repartitionByRange("a", "b").withColumn("part", F.spark_partition_id()), "ranges")
    starts = ranges.groupBy("part").agg(F.sum("n").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("n").over(inside), F.lit(0))
    return ranges.withColumn("running", running).join(starts, "part").select("a", "b", (F.col("start") + F.col("running")).alias("rank"))


def levels(docs: DataFrame, depth: int = MIN_LINES) -> Iterator[tuple[int, DataFrame]]:
    """Each depth with ``(id, text_hash, line, words, rank)`` of all suffixes that share their first lines up to there.

    Words are those of the first lines, of which there are as many as the depth.
    """
    active = line_rows(docs)
    done = 0
    while done < depth:
        # Depth 1, 2, 4 and so on; the last step overlaps the halves if the depth is no power of two.
        if done:
            step = min(done, depth - done)
            ahead = Window.partitionBy("id", "text_hash").orderBy("line").rangeBetween(step, step)
            active = active.withColumns({"b": F.first("rank").over(ahead), "more": F.first("words").over(ahead)})
            active = active.filter(F.col("b").isNotNull()).withColumnRenamed("rank", "a")
            active = active.withColumn("words", F.col("words") + F.col("more")).drop("more")
            done += step
        else:
            done = 1
        active = stored(active, "pairs")
        active = active.join(ranked(active), ["a", "b"]).select("id", "text_hash", "line", "words", "rank")
        active = stored(active, "suffixes")
        yield done, active


def later_copies(docs: DataFrame, depth: int = MIN_LINES, words: int = MIN_WORDS) -> DataFrame:
    """``(id, text_hash, starts)``: the lines of each document at which later copies begin, and how many lines these have."""
    here = F.struct("id", "text_hash", "line")
    found = []
    for size, array in levels(docs, depth):
        # Half-overlapping steps count words twice; below the last depth they don't overlap.
        array = array if size == depth else array.filter(F.col("words") >= words)
        first = array.groupBy("rank").agg(F.min(here).alias("first"))
        later = array.join(first, "rank").filter(here > F.col("first"))
        found.append(later.select("id", "text_hash", F.struct("line", F.lit(size).alias("size")).alias("start")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("id", "text_hash").agg(F.collect_set("start").alias("starts"))


def deduplicated(docs: DataFrame, depth: int = MIN_LINES, words: int = MIN_WORDS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: the kept text, its lines, deleted lines, and deleted runs."""
    copies = stored(later_copies(docs, depth, words), "copies")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("text_hash"),
        F.split(text, "\n").alias("lines"),
    )
    # The same join at every size: copies grow with the documents.
    both = rows.join(copies.hint("merge"), ["id", "text_hash"], "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["line"], s["line"] + s["size"] - 1))))
    both = both.withColumn("gone", F.coalesce(covered, F.array().cast("array<int>")))
    kept = F.filter("lines", lambda _, i: ~F.array_contains("gone", i))
    heads = F.filter("gone", lambda i: ~F.array_contains("gone", i - 1))
    return both.select(
        "doc_id",
        F.when(F.size("gone") > 0, F.array_join(kept, "\n")).otherwise(F.array_join("lines", "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.size(heads).cast("long").alias("n_runs"),
    )
