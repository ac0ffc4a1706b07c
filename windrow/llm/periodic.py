"""Periodic stretches of word sequences, found by constant-time longest common extensions.

A run is a stretch of words with a smallest period q that fits ``LEAST_PERIODS`` times into it, of at least
``LEAST_WORDS`` words, which no neighbouring word extends. Each run, seen under one of two orders of the words (any
order and its reverse), holds a root: the longest Lyndon word that starts at some position. So these are the only
candidates, two for each position:

* a suffix tree of the words is built by Ukkonen's algorithm; its leaves in depth-first order rank the suffixes under both
  orders, and the next smaller suffix ends the longest Lyndon word of a position;
* the tree's Euler tour with a sparse table of minima gives the lowest common ancestor of two leaves in constant time,
  whose depth is how far two suffixes agree; so a root is extended to the right;
* the same over the reversed words extends it to the left.

Trees are built only over stretches that may hold a run. Eight consecutive words inside a run occur twice in it: as
the run has three periods and 24 words, a shift by one period to one of both sides stays inside. Words outside such
repeats are skipped; the test is exact in one direction, and a collision of its hashes only makes a stretch longer.
Texts are handled row by row without a shuffle; a task holds one slice of texts, and the trees of one stretch, some
hundred bytes a word of it.

Defined results: null, empty and blank texts have no words and no runs. Repeated rows are handled one by one. Long texts are
handled whole, a text beyond a slice alone. Extra columns are kept by ``collapsed``, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import column, per_row, prepared, schema_with, slices, split_words, whole_row

LEAST_WORDS = 24
LEAST_PERIODS = 3
# Words that must occur twice; at most what a run of 24 words and three periods guarantees.
GRAM = 8
MIX = np.uint64(0x9E3779B97F4A7C15)
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (from 1) and an end mark below all of them; a leaf for each suffix."""

    def __init__(self, symbols: Sequence[int]):
        text = [*symbols, 0]
        self.n = n = len(text)
        self.sigma = sigma = max(text) + 1
        begin, stop, link = [0], [0], [0]
        edges: dict[int, int] = {}
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * sigma + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(begin)
                    begin.append(i)
                    stop.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = node
                else:
                    at = begin[child]
                    size = stop[child] - at
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if text[at + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    split = len(begin)
                    begin += (at, i)
                    stop += (at + length, n)
                    link += (0, 0)
                    edges[key] = split
                    edges[split * sigma + symbol] = split + 1
                    begin[child] = at + length
                    edges[split * sigma + text[at + length]] = child
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.children = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        parents, self.symbols = np.divmod(keys[order], sigma)
        self.first = np.searchsorted(parents, np.arange(len(begin) + 1)).tolist()
        self.sizes = (np.array(stop) - np.array(begin)).tolist()

    def ranks(self, reverse: bool) -> list[int]:
        """Place of every suffix in the order of the symbols or in the reverse one; the end mark is lowest in both."""
        first, children, sizes, symbols = self.first, self.children, self.sizes, self.symbols
        depth = [0] * len(sizes)
        rank = [0] * self.n
        stack, place = [0], 0
        while stack:
            x = stack.pop()
            a, b = first[x], first[x + 1]
            if a == b:
                rank[self.n - depth[x]] = place
                place += 1
                continue
            below = children[a:b]
            if not reverse:
                below.reverse()
            elif symbols[a] == 0:
                below.append(below.pop(0))
            here = depth[x]
            for child in below:
                depth[child] = here + sizes[child]
            stack += below
        return rank

    def extensions(self) -> Extensions:
        """The Euler tour of string depths, ready for queries."""
        first, children, sizes, n = self.first, self.children, self.sizes, self.n
        depth = [0] * len(sizes)
        tour: list[int] = []
        at = [0] * n
        stack = [0]
        while stack:
            x = stack.pop()
            if x < 0:
                tour.append(depth[~x])
                continue
            here = depth[x]
            a, b = first[x], first[x + 1]
            if a == b:
                at[n - here] = len(tour)
            else:
                for child in children[a:b]:
                    depth[child] = here + sizes[child]
                    stack += (~x, child)
            tour.append(here)
        return Extensions(np.array(tour, np.int32), np.array(at, np.int64))


class Extensions:
    """Longest common extensions: the least depth of the tour between two leaves, from a sparse table of minima."""

    def __init__(self, tour: np.ndarray, at: np.ndarray):
        self.at = at
        self.minima = [tour]
        width = 1
        while 2 * width <= len(tour):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``i`` and at ``j``, another one, have in common."""
        a, b = self.at[i], self.at[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            table = self.minima[k]
            out[own] = np.minimum(table[low[own]], table[high[own] + 1 - (1 << k)])
        return out


def lyndon_lengths(rank: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word from each position: up to the next smaller suffix."""
    n = len(rank) - 1
    smaller = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = smaller[j]
        smaller[i] = j
    return np.array(smaller[:n], np.int64) - np.arange(n)


def runs_in(symbols: Sequence[int], words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start, then period. Symbols are whole numbers from 1."""
    n = len(symbols)
    tree = SuffixTree(symbols)
    roots = np.concatenate([lyndon_lengths(tree.ranks(reverse)) for reverse in (False, True)])
    start = np.tile(np.arange(n), 2)
    short = roots * periods <= n
    start, period = start[short], roots[short]
    right = tree.extensions().of(start, start + period)
    del tree
    # What cannot reach one root's length on both sides together is no run of two periods.
    left = SuffixTree(symbols[::-1]).extensions().of(n - start, n - start - period)
    length = left + period + right
    own = (length >= periods * period) & (length >= words)
    found = np.stack([start - left, length, period], axis=1)[own]
    found = np.unique(found, axis=0)
    return [tuple(x) for x in found[np.lexsort((found[:, 2], found[:, 0]))].tolist()]


def stretches(codes: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """Where words ``[begin, stop)`` may hold runs: all groups of ``GRAM`` words in them occur again in their row."""
    n = len(codes) - GRAM + 1
    if n <= 0:
        return []
    hashes = rows[:n].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            hashes *= MIX
            hashes ^= hashes >> np.uint64(31)
            hashes += codes[k : k + n].astype(np.uint64)
        hashes *= MIX
    inside = rows[:n] == rows[GRAM - 1 :]
    which = pd.factorize(hashes)[0]
    again = inside & (np.bincount(which[inside], minlength=which.max() + 1)[which] > 1)
    # Where a stretch goes on, it does so in the same row.
    goes_on = again[1:] & again[:-1] & (rows[1:n] == rows[: n - 1])
    begins = np.flatnonzero(again & ~np.append(False, goes_on))
    ends = np.flatnonzero(again & ~np.append(goes_on, False))
    long = ends - begins + GRAM >= LEAST_WORDS
    return list(zip(begins[long].tolist(), (ends[long] + GRAM).tolist(), strict=True))


def found_runs(words: pa.Array, rows: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs in the rows' words, starts counted over all words of all rows."""
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    out = []
    for begin, stop in stretches(codes, rows):
        symbols = (np.unique(codes[begin:stop], return_inverse=True)[1] + 1).tolist()
        out += [(begin + start, length, period) for start, length, period in runs_in(symbols)]
    return out


def collapsed_slice(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Words, runs and collapsed text of each text."""
    words, rows = split_words(texts)
    sizes = per_row(rows, len(texts))
    firsts = np.cumsum(sizes) - sizes
    runs: list[list[dict]] = [[] for _ in range(len(texts))]
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in found_runs(words, rows):
        row = int(rows[start])
        runs[row].append({"start": start - int(firsts[row]), "length": length, "period": period})
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    held = words.filter(pa.array(kept)) if not kept.all() else words
    ends = np.append(0, np.cumsum(per_row(rows[kept], len(texts))))
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), held.cast(pa.large_string()))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for own in runs:
        own.sort(key=lambda r: (r["start"], r["period"]))
    return pa.array(sizes, pa.int64()), pa.array(runs, kind), pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def collapsed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(text, ...)`` as ``row``, with their words, runs and the text without what repeats.

    A word is dropped from the collapsed text if a run holds it after that run's first period. Kept words are joined by one
    blank.
    """
    prepared(docs.sparkSession)
    rows = docs.select(whole_row(docs), F.col("text").cast("string").alias("text"))
    carried = [f for f in rows.schema.fields if f.name == "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = collapsed_slice(column(part, "text"))
            yield pa.RecordBatch.from_arrays([column(part, "row"), *found], names=["row", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, schema_with(carried, FOUND))


def longest(runs: Column) -> Column:
    """The run with the greatest length for its period, by exact comparison; the first one by start and period of several."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def with_tails(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the ends of some texts made periodic, by a checksum of their ids.

    Where h = crc32(doc_id) is a multiple of ten and g = h div 10, the n words from a = g mod n on repeat those from a to
    a + p, with p = 1 + (n - a) div (3 + g mod 8). A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))
    chosen = F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.withColumn("words", chosen).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    made = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
