"""Prefix trie of conversations by blocks of turns.

A turn is named by a digest of its role and text, and a conversation is its turns in order, cut into blocks of
``BLOCK_TURNS``. A block is named by a hash of its number and its digests; the blocks before it by the exclusive or of
their names, 128 bits wide, so that a prefix of any length is known from one running aggregate. Conversations are first
grouped by whole blocks: equal blocks behind equal blocks are one class, aggregated before they are shuffled. Where all
conversations of a prefix share the next block, its turns are nodes of these same members and nothing more is
compared. Only where siblings diverge inside a block, or one of them ends there, its classes are grouped turn by turn.

Sums over subtrees go along paths. A node is owned by that one of its members whose id has the least hash, so nodes of one
owner are a path down to the end of that conversation, and a node has all its further ones below it on its path or
hanging off it. Path totals are handed up from path to path, a round of joins for each level; as hashes are in no order, the
levels grow with the logarithm of the conversations, chains of ever longer copies included. Then one running sum
along each path gives every node's total. Long conversations are numbered and summed by segments, so that none of them is
ever one task's work.

Members that end at a node are digested in order. That is sequential by nature: ids are joined in chunks of
``CHUNK_IDS`` across tasks, and the chunks of a node stream through one digest, in bounded memory.

Defined results: rows without conv_id are left out. Null roles and texts are empty. A null turn comes first; turns of one
number come in the order of their digests, repeated rows are repeated turns. Texts of any length are digested whole, once, and not
shuffled. Without conversations there is no node, not even a root. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.common import prepared, stored

BLOCK_TURNS = 4
# Blocks, or depths, that one task sums up in a row.
SEGMENT = 4096
CHUNK_IDS = 10_000
# Rule of the rebuilt conversations: each borrows fewer turns than this from the first of its hundred.
BORROWED, FAMILY = 6, 100


def turn_table(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, digest, chars)``: the turns of each conversation by their place in it, from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    ranges = stored(rows.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()), "turns")
    sizes = ranges.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "digest")
    placed = ranges.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["conv_id", "part"])
    return stored(placed.select("conv_id", (F.col("start") + F.col("nth")).alias("place"), "digest", "chars"), "places")


def rebuilt(turns: DataFrame, most: int = BORROWED, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Turns of every conversation with its first h ones replaced by those of the first of its family, and all ids.

    h is crc32(conv_id) mod ``most``, and the first of a family is conv_id - conv_id mod ``family``.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    ids = turns.select("conv_id").distinct()
    named = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    heads = turns.filter((F.col("conv_id") % family == 0) & (F.col("place") < most - 1))
    heads = heads.select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    sizes = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    named = named.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0))))
    named = stored(named.select("conv_id", "base", "h", "taken"), "families")
    columns = ["conv_id", "place", "digest", "chars"]
    borrowed = named.filter("taken > 0").join(heads, "base").filter(F.col("place") < F.col("h")).select(columns)
    own = turns.join(named, "conv_id").filter(F.col("place") >= F.col("h"))
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("taken")).select(columns)
    return stored(borrowed.unionByName(own), "rebuilt"), ids


def running(rows: DataFrame, keys: list[str], order: str, found: dict[str, Column], backward: bool = False) -> DataFrame:
    """``rows`` with aggregates of all rows of a key before each one, or from each one on if ``backward``.

    ``found`` names the aggregates; they must be their own merge, like sums. Keys of any size are cut into segments, summed
    up apart; a row per segment carries the rest.
    """
    rows = rows.withColumn("segment", F.floor(F.col(order) / SEGMENT))
    totals = rows.groupBy(*keys, "segment").agg(*(c.alias(f"{n}_total") for n, c in found.items()))
    # Merging uses the same function on the totals.
    merge = {n: F.bit_xor(f"{n}_total") if n.startswith("xor") else F.sum(f"{n}_total") for n in found}
    direction = F.col("segment").desc() if backward else F.col("segment")
    others = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "segment", *(F.coalesce(c.over(others), F.lit(0)).alias(f"{n}_rest") for n, c in merge.items()))
    direction = F.col(order).desc() if backward else F.col(order)
    inside = Window.partitionBy(*keys, "segment").orderBy(direction)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if backward else -1)
    rows = rows.select("*", *(F.coalesce(c.over(inside), F.lit(0)).alias(f"{n}_here") for n, c in found.items()))
    both = rows.join(totals, [*keys, "segment"])
    for n in found:
        here, rest = F.col(f"{n}_here"), F.col(f"{n}_rest")
        both = both.withColumn(n, here.bitwiseXOR(rest) if n.startswith("xor") else here + rest)
    return both.drop("segment", *(f"{n}_{x}" for n in found for x in ("here", "rest")))


def blocks(turns: DataFrame) -> DataFrame:
    """``(conv_id, block, xor_a, xor_b, steps)``: every block, the name of all before it, and its turns.

    A step has the name of the block up to its turn, and the code points of the turn.
    """
    offset = F.col("place") % BLOCK_TURNS
    cut = turns.withColumn("block", F.floor(F.col("place") / BLOCK_TURNS)).groupBy("conv_id", "block")
    # At most BLOCK_TURNS entries each.
    cut = cut.agg(F.sort_array(F.collect_list(F.struct(offset.alias("offset"), "digest", "chars"))).alias("turns"))
    digests = F.col("turns.digest")
    steps = [
        F.when(
            F.size("turns") > i,
            F.struct(
                F.xxhash64(F.lit(1), "block", F.slice(digests, 1, i + 1)).alias("a"),
                F.xxhash64(F.lit(2), "block", F.slice(digests, 1, i + 1)).alias("b"),
                F.col("turns")[i]["chars"].alias("chars") if i == 0 else F.try_element_at("turns", F.lit(i + 1))["chars"].alias("chars"),
            ),
        )
        for i in range(BLOCK_TURNS)
    ]
    cut = cut.select("conv_id", "block", F.array_compact(F.array(*steps)).alias("steps"))
    last = F.element_at("steps", -1)
    cut = stored(cut.withColumns({"a": last["a"], "b": last["b"]}), "blocks")
    return running(cut, ["conv_id"], "block", {"xor_a": F.bit_xor("a"), "xor_b": F.bit_xor("b")})


MEMBERS = {
    "n_convs": F.sum,
    "conv_id": F.min,
    "owner": F.min,
}


def nodes(blocked: DataFrame, ids: DataFrame) -> DataFrame:
    """``(depth, a, b, up_a, up_b, chars, n_convs, conv_id, owner)``: all nodes, named by hash, and the names of their parents."""
    group = ["block", "xor_a", "xor_b"]
    owner = F.struct(F.xxhash64("conv_id").alias("hash"), F.col("conv_id").alias("id"))
    classes = blocked.groupBy(*group, "a", "b").agg(
        F.first("steps").alias("steps"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.min(owner).alias("owner"),
    )
    classes = stored(classes, "classes")
    variants = classes.groupBy(*group).agg(F.count(F.lit(1)).alias("variants"))
    steps = classes.join(variants, group).select(
        *group, "variants", *MEMBERS, F.posexplode("steps").alias("offset", "step"), "steps"
    )
    before = F.when(F.col("offset") > 0, F.try_element_at("steps", F.col("offset")))
    steps = steps.select(
        *group,
        "variants",
        *MEMBERS,
        (F.col("block") * BLOCK_TURNS + F.col("offset") + 1).alias("depth"),
        F.col("xor_a").bitwiseXOR(F.col("step.a")).alias("a"),
        F.col("xor_b").bitwiseXOR(F.col("step.b")).alias("b"),
        F.col("xor_a").bitwiseXOR(F.coalesce(before["a"], F.lit(0))).alias("up_a"),
        F.col("xor_b").bitwiseXOR(F.coalesce(before["b"], F.lit(0))).alias("up_b"),
        F.col("step.chars").alias("chars"),
    )
    columns = ["depth", "a", "b", "up_a", "up_b", "chars", *MEMBERS]
    together = steps.filter("variants = 1").select(columns)
    apart = steps.filter("variants > 1").groupBy("depth", "a", "b", "up_a", "up_b", "chars")
    apart = apart.agg(*(f(c).alias(c) for c, f in MEMBERS.items())).select(columns)
    root = ids.agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(owner).alias("owner")
    ).filter("n_convs > 0")
    nothing = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = root.select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), nothing.alias("up_a"), nothing.alias("up_b"), zero.alias("chars"), *MEMBERS
    )
    return together.unionByName(apart).unionByName(root).withColumn("owner", F.col("owner.id"))


def streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids, those of a node one after another and in order, to a digest of each node's."""
    key, digest = None, None
    for batch in batches:
        done = []
        for *own, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids")), strict=True):
            if own != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done, strict=True))), names=["depth", "a", "b", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=["depth", "a", "b", "ends_sha256"])


def end_digests(blocked: DataFrame, ids: DataFrame) -> DataFrame:
    """``(depth, a, b, ends_sha256)`` of the nodes at which conversations end."""
    last = F.max_by(F.struct("xor_a", "xor_b", "a", "b", F.size("steps").alias("n")), "block").alias("last")
    ends = blocked.groupBy("conv_id").agg(F.max("block").alias("block"), last)
    ends = ids.join(ends, "conv_id", "left").select(
        "conv_id",
        F.coalesce(F.col("block") * BLOCK_TURNS + F.col("last.n"), F.lit(0)).alias("depth"),
        F.coalesce(F.col("last.xor_a").bitwiseXOR(F.col("last.a")), F.lit(0)).alias("a"),
        F.coalesce(F.col("last.xor_b").bitwiseXOR(F.col("last.b")), F.lit(0)).alias("b"),
    )
    node = ["depth", "a", "b"]
    ends = stored(ends.repartitionByRange(*node, "conv_id").withColumn("part", F.spark_partition_id()), "ends")
    nth = F.row_number().over(Window.partitionBy(*node, "part").orderBy("conv_id")) - 1
    chunks = ends.withColumn("chunk", F.floor(nth / CHUNK_IDS)).groupBy(*node, "part", "chunk")
    # At most CHUNK_IDS ids each.
    chunks = chunks.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    chunks = stored(chunks, "chunks").repartition(*node).sortWithinPartitions(*node, "part", "chunk")
    return chunks.select(*node, "ids").mapInArrow(streamed_digests, "depth long, a long, b long, ends_sha256 string")


def subtree_sums(found: DataFrame) -> DataFrame:
    """``found(owner, depth, up_owner, leaf, saved)`` to ``(owner, depth, n_leaves, saved_tokens)``, summed over subtrees."""
    own = found.select("owner", "depth", F.col("leaf").alias("leaves"), "saved")
    tops = found.filter((F.col("up_owner") != F.col("owner"))).select(
        "owner", F.col("up_owner").alias("up"), (F.col("depth") - 1).alias("up_depth")
    )
    tops = stored(tops, "paths")
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    parts, carried = [own], own
    while True:
        totals = carried.groupBy("owner").agg(*sums)
        handed = totals.join(tops, "owner").groupBy(F.col("up").alias("owner"), F.col("up_depth").alias("depth")).agg(*sums)
        carried = stored(handed, "handed")
        if carried.isEmpty():
            break
        parts.append(carried)
    every = reduce(DataFrame.unionByName, parts).groupBy("owner", "depth").agg(*sums)
    summed = running(every, ["owner"], "depth", {"n_leaves": F.sum("leaves"), "saved_tokens": F.sum("saved")}, backward=True)
    return summed.select("owner", "depth", "n_leaves", "saved_tokens")


def trie(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """All nodes of the trie of ``turns(conv_id, place, digest, chars)``, places from 0 without gaps.

    ``ids(conv_id)`` names all conversations, also those without turns; by default those that have some.
    """
    prepared(turns.sparkSession)
    ids = stored(turns.select("conv_id").distinct() if ids is None else ids, "ids")
    blocked = stored(blocks(turns), "prefixes")
    every = stored(nodes(blocked, ids), "nodes")
    node = ["depth", "a", "b"]
    children = every.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    every = every.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = every.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("a").alias("up_a"),
        F.col("b").alias("up_b"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("owner").alias("up_owner"),
    )
    every = stored(every.join(parents, ["depth", "up_a", "up_b"], "left"), "linked")
    leaf = (F.col("n_children") == 0).cast("long").alias("leaf")
    sums = subtree_sums(every.select("owner", "depth", "up_owner", leaf, ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        every.join(sums, ["owner", "depth"])
        .join(end_digests(blocked, ids), node, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of ``conversations(conv_id, turn, role, text)``."""
    return trie(turn_table(conversations))
