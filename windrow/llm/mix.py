"""Mixing sources to target weights by the cube method.

Each source has a target number of words. A document is expected target / source size times in the mix; the whole part
of that is certain, and the fraction is an inclusion probability. The cube method moves these probabilities to 0 or 1
while the expected number of words and of documents of the source stay what they were: of three undecided documents,
the two balancing totals leave one direction in which their probabilities can move, and they move along it, either way
with the odds that keep the expectation, until one of them is decided.

Documents are balanced in blocks of a few thousand of one source, so that a source with a third of all documents is
many blocks. A block leaves at most two documents undecided; these are balanced again, in blocks, until each source is
a single block. There the landing gives up the count of documents, then the words, and decides the last ones.

Choices are drawn from the id of the block and the round, and rows are ordered within it, so that reruns agree.

Defined results: a null text has size 0; sizes of 0 are drawn too, and take nothing. A null source is a source, after
all others. Sources whose documents have no words have target 0. Repeated rows are drawn one by one. An empty table
gives an empty mix.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.common import WORD, prepared, stored, whole_row

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = (3, 2)  # the mix has 150% of all words
MOST_REPEATS = 2
BLOCK_ROWS = 4096
EPSILON = 1e-9
# Rows that one equal row stands for at a time.
NUMBERED = 10_000
ROW = ("doc_id", "source", "size", "tie", "tie2", "nth")


def sizes(docs: DataFrame) -> DataFrame:
    """The rows with ``size``, the number of words of the text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(rows: DataFrame) -> DataFrame:
    """A row per source: its rank, documents, words, and target.

    Resharing what capped sources leave comes down to one level: a source gets its weight times the level, at most
    twice its size. Sources reach their cap in the order of twice their size by weight, so the level follows from
    running sums in that order. These two windows run over a row per source.
    """
    source = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    up, down = TOTAL_SHARE
    # Integers up to the one division, so that the level doesn't depend on the order of summing.
    open_words = up * F.sum("source_size").over(everything) - down * MOST_REPEATS * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = (
        source.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("open_words", open_words)
        .withColumn("open_weight", open_weight)
    )
    # The first source in order of caps that does not reach its own sets the level.
    is_open = F.col("weight") * F.col("open_words") < down * MOST_REPEATS * F.col("source_size") * F.col("open_weight")
    return (
        ranked.withColumn("is_open", is_open)
        .withColumn("order", F.row_number().over(by_cap))
        .withColumn("open_from", F.min(F.when(is_open, F.col("order"))).over(everything))
        .withColumn(
            "level", F.max(F.when(F.col("order") == F.col("open_from"), F.struct("open_words", "open_weight"))).over(everything)
        )
        .withColumn(
            "target",
            F.when(
                F.col("order") >= F.col("open_from"),
                F.col("weight") * F.col("level.open_words") / (down * F.col("level.open_weight")),
            ).otherwise((MOST_REPEATS * F.col("source_size")).cast("double")),
        )
        .select("source", "rank", "n_docs", "source_size", "target")
    )


def flight(size: np.ndarray, chance: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Moves the chances until at most two are neither 0 nor 1; keeps their sum and their sum by size.

    Three undecided documents a, b, c can move by (size_b - size_c, size_c - size_a, size_a - size_b), which changes
    neither total. Of three equal sizes, the first two trade chance.
    """
    chance = chance.copy()
    held: list[int] = []
    for k in np.flatnonzero((chance > EPSILON) & (chance < 1 - EPSILON)):
        held.append(int(k))
        if len(held) < 3:
            continue
        a, b, c = held
        move = (float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b]))
        step(chance, held, move if any(move) else (1.0, -1.0, 0.0), draws[k])
        held = [i for i in held if EPSILON < chance[i] < 1 - EPSILON]
    return chance


def step(chance: np.ndarray, members: list[int], move: tuple[float, ...], draw: float) -> None:
    """Moves along ``move`` or against it until a chance is 0 or 1, with odds that keep every expectation."""
    ahead = back = math.inf
    for i, m in zip(members, move, strict=True):
        if m:
            up, down = (1 - chance[i]) / abs(m), chance[i] / abs(m)
            ahead, back = min(ahead, up if m > 0 else down), min(back, down if m > 0 else up)
    by = ahead if draw < back / (ahead + back) else -back
    for i, m in zip(members, move, strict=True):
        moved = chance[i] + by * m
        chance[i] = 0.0 if moved < EPSILON else 1.0 if moved > 1 - EPSILON else moved


def landing(size: np.ndarray, chance: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Decides what the flight has left: two documents by words alone, the last by its chance; a row of draws for each."""
    chance = chance.copy()
    left = np.flatnonzero((chance > EPSILON) & (chance < 1 - EPSILON))
    if len(left) == 2:
        a, b = map(int, left)
        if size[a] and size[b]:
            step(chance, [a, b], (float(size[b]), -float(size[a])), draws[0, a])
        left = np.flatnonzero((chance > EPSILON) & (chance < 1 - EPSILON))
    for i in left:
        chance[i] = float(draws[1, i] < chance[i])
    return chance


def balance(group: pd.DataFrame) -> pd.DataFrame:
    """One block: rows in a fixed order, a flight, and a landing where the block is the source's only one."""
    group = group.sort_values(["doc_id", "size", "tie", "tie2", "nth"], na_position="first").reset_index(drop=True)
    key = f"{group['rank'][0]}/{group['block'][0]}/{group['round'][0]}"
    draws = np.random.default_rng(zlib.crc32(key.encode())).random((3, len(group)))
    size = group["size"].to_numpy(np.int64)
    chance = flight(size, group["chance"].to_numpy(float), draws[0])
    if group["blocks"][0] == 1:
        chance = landing(size, chance, draws[1:])
    return group.assign(chance=chance)


def mixed(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of ``docs(doc_id, text, source)``: size, source size, target, copies in the mix, and words taken."""
    rows = sizes(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("text").cast("string"),
            F.col("source").cast("string"),
            F.xxhash64("text").alias("tie"),
            F.lit(0).cast("long").alias("tie2"),
        )
    )
    return drawn(rows.drop("text"), block_rows).drop("tie", "tie2", "nth")


def resampled(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns, whatever these are called.

    Rows that agree in every column can't be told apart, nor need to be: each is drawn for, and their draws are added up on
    one of them. Columns of any type are told apart, maps by their JSON.
    """
    named = docs.select(whole_row(docs), comparable(docs).alias("told"))
    whole = named.select("row", F.xxhash64("told").alias("tie"), F.xxhash64(F.lit(1), F.col("told")).alias("tie2"))
    rows = whole.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.col("row.text").cast("string").alias("text"),
        F.col("row.source").cast("string").alias("source"),
        "tie",
        "tie2",
    )
    draws = drawn(sizes(rows).drop("text"), block_rows).groupBy("tie", "tie2").agg(F.sum("copies").alias("copies"))
    return (
        whole.groupBy("tie", "tie2")
        .agg(F.first("row").alias("row"))
        .join(draws.filter(F.col("copies") > 0), ["tie", "tie2"])
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("row.*")
    )


def comparable(docs: DataFrame) -> Column:
    """All columns as one that can be hashed: those that hold a map as JSON text."""
    columns = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema.fields]
    held = ["map<" in f.dataType.simpleString() for f in docs.schema.fields]
    return F.struct(*(F.to_json(F.struct(c.alias("held"))) if m else c for c, m in zip(columns, held, strict=True)))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows, equal ones told apart by ``nth`` from 0, so that any number of them is dealt into many blocks."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times"))
    # In two steps, as one row may stand for very many.
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(NUMBERED).cast("long")))
    parts = counted.select(*rows.columns, "times", starts.alias("from"))
    last = F.least(F.col("times"), F.col("from") + NUMBERED) - 1
    return parts.select(*rows.columns, F.explode(F.sequence("from", last)).alias("nth"))


def drawn(rows: DataFrame, block_rows: int) -> DataFrame:
    """The mix of ``rows(doc_id, source, size, tie, tie2)``; the ties order rows of one id."""
    prepared(rows.sparkSession)
    rows = stored(numbered(rows), "sizes")
    plan = stored(targets(rows), "targets")
    joined = rows.withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    plan = plan.withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    waiting = (
        joined.join(plan, "named")
        .withColumn("whole", F.floor(ratio + EPSILON).cast("int"))
        .withColumn("chance", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
        .select(*ROW, "rank", "source_size", "target", "whole", "chance")
    )
    schema = waiting.withColumns({c: F.lit(0).cast("long") for c in ("n", "blocks", "block")}).withColumn(
        "round", F.lit(0)
    )
    counts = plan.select("rank", F.col("n_docs").alias("n"))
    undecided = (F.col("chance") > EPSILON) & (F.col("chance") < 1 - EPSILON)
    # Copies of one row go round the blocks.
    copy = F.pmod("nth", F.col("blocks"))
    parts = []
    for turn in range(64):
        blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.lit(1)).cast("long")
        dealt = (
            waiting.join(counts, "rank")
            .withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.pmod(F.xxhash64("doc_id", "size", "tie", "tie2", F.lit(turn)), F.col("blocks")) + copy, F.col("blocks")))
            .withColumn("round", F.lit(turn))
            .select(*schema.columns)
        )
        done = stored(dealt.groupBy("rank", "block").applyInPandas(balance, schema.schema), "balanced")
        parts.append(done.filter(~undecided))
        waiting = done.filter(undecided).select(*waiting.columns)
        counts = waiting.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
        if waiting.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = F.col("whole") + F.rint("chance").cast("int")
    return out.select(
        *ROW,
        "source_size",
        "target",
        copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )
