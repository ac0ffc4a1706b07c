"""Benchmark decontamination by Wu-Manber search.

Benchmark texts are cut into windows of ten words; a shorter text is one window. The symbols searched are words, so a
window is a pattern of up to ten symbols. Patterns of one length form a class with three tables:

* shift: a block of words to how far the search may jump when that block ends at the current position; a block that is
  in no pattern of the class allows the longest jump, and most blocks of clean text are such;
* buckets: the hash of a pattern's last block to the patterns that end with it, reached where the shift is zero;
* the patterns themselves, which are compared word by word before anything counts as an occurrence.

The tables of one block of windows are broadcast. A block holds at most ``MAX_WINDOWS`` windows; a larger benchmark
is searched block by block, each pass adding to the spans and items that earlier passes found, so that the broadcast
has a proven bound and nothing is left out. Documents are read once and never shuffled.

Defined results: null and empty texts have no words, no hits and are clean. Null or blank items have no windows. A null
``item_id`` counts as the empty string. Repeated document rows are searched one by one, repeated items count once.
An empty benchmark finds nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import ALNUM_WORD, column, prepared, schema_with, slices, stored, whole_row

WINDOW = 10
BLOCK = 3
MAX_WINDOWS = 50_000
# Bytes of a normalised text: A-Z becomes a-z, what is no word becomes a blank.
NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
FOUND = "n_words long, spans array<struct<begin: long, stop: long>>, items array<string>"


def normal_words(text: Column) -> Column:
    """Words of the text, A-Z lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"({ALNUM_WORD})"), F.lit(1))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Every distinct window of the items, its number of words and the items that hold it."""
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), normal_words(F.col("text")).alias("words")
    ).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return (
        words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, size))).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item_id").alias("items"))
        .withColumn("block", F.xxhash64("words"))
    )


class Search:
    """Tables of one block of windows."""

    def __init__(self, patterns: list[tuple[list[str], list[str]]], block: int = BLOCK):
        classes = defaultdict(list)
        for words, items in patterns:
            classes[len(words)].append((tuple(w.encode() for w in words), items))
        self.classes = []
        for length, members in sorted(classes.items()):
            width = min(block, length)
            longest = length - width + 1
            shift: dict[tuple, int] = {}
            buckets = defaultdict(list)
            for words, items in members:
                for end in range(width, length + 1):
                    part = words[end - width : end]
                    shift[part] = min(shift.get(part, longest), length - end)
                buckets[words[-width:]].append((words, items))
            self.classes.append((length, width, longest, shift, dict(buckets)))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words inside occurrences, and the items whose windows occur."""
        spans, items = [], set()
        for length, width, longest, shift, buckets in self.classes:
            at = length
            last = len(words)
            while at <= last:
                part = tuple(words[at - width : at])
                jump = shift.get(part, longest)
                if jump:
                    at += jump
                    continue
                here = tuple(words[at - length : at])
                for pattern, owners in buckets[part]:
                    if pattern == here:
                        spans.append((at - length, at))
                        items.update(owners)
                        break
                at += 1
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, stop in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((begin, stop))
    return out


def search_pass(docs: DataFrame, patterns: list[tuple[list[str], list[str]]], first: bool) -> DataFrame:
    """Adds what one block of windows finds to ``spans`` and ``items``; the first pass makes these columns."""
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(Search(patterns))
    keep = [f for f in docs.schema.fields if f.name not in ("n_words", "spans", "items")]
    schema = schema_with(keep, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = tables.value
        for part in slices(batches, "text"):
            counts, spans, items = [], [], []
            carried = None if first else zip(column(part, "spans").to_pylist(), column(part, "items").to_pylist(), strict=True)
            for text in column(part, "text").to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()
                found, owners = search.find(words)
                if carried is not None:
                    before, known = next(carried)
                    found = merge(found + [(s["begin"], s["stop"]) for s in before])
                    owners |= set(known)
                counts.append(len(words))
                spans.append([{"begin": a, "stop": b} for a, b in found])
                items.append(sorted(owners))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(part, f.name) for f in keep),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, kind),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[*(f.name for f in keep), "n_words", "spans", "items"],
            )

    return docs.mapInArrow(run, schema)


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` (with a column ``text``) and its number of words, spans of hit words and items found."""
    spark = docs.sparkSession
    prepared(spark)
    patterns = stored(windows(benchmark, size), "windows")
    blocks = max(1, -(-patterns.count() // most))
    for block in range(blocks):
        part = patterns.filter(F.pmod("block", F.lit(blocks)) == block)
        rows = [(r.words, r["items"]) for r in part.select("words", "items").collect()]
        docs = search_pass(docs, rows, first=block == 0)
        if block < blocks - 1:
            docs = stored(docs, "searched")
    return docs


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with their own columns, whatever these are called."""
    rows = docs.select(whole_row(docs), F.col("text").cast("string").alias("text"))
    return hits(rows, benchmark).filter(F.size("spans") == 0).select("row.*")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: words, hit words, items, their digest, and the verdict."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["begin"])
    return hits(rows, benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
