"""SimHash near-duplicates by BK-trees.

A fingerprint bit is 1 where more than half of a text's word shingles have it in their hash. Equal fingerprints are one
entry. Entries are dealt into shards so that linked ones meet in at least one; each shard's entries go into a BK-tree,
whose children are keyed by their Hamming distance to the parent, and a search follows only edges within the radius of
its own distance. A shard reports the links that hold its components together, not all pairs. Components of all shards'
links follow by joins.

Trees are built where their shard is and not broadcast, as they grow with the data. Two ways of dealing:

* ``block_links`` is exact. With radius 2 and four blocks of 16 bits, two fingerprints agree on at least two blocks, so
  each entry goes to six shards, named by two of its blocks. A shard beyond ``SHARD_ROWS`` is dealt once more by a
  third of its other bits, on which linked fingerprints must agree again, and the last level has at most 2^15 entries
  by the number of bits that are left.
* ``band_links`` is for wide fingerprints and a large radius, where no blocks agree: shards are named by bands of
  minimum hashes of the shingles, which similar texts share. Where too many entries share a band, those within the
  radius of one of them, its pivot, are linked to it. The others are dealt into blocks, and so are those at the pivot;
  every block is compared with every other and itself, but for those at the pivot, which are linked already. All
  pairs of a band are thus seen at any size, and the work grows with a band's entries times those not at its pivot.

Defined results: null and blank texts have no shingle, fingerprint zero, and link like any other. A text of fewer words
than a shingle is one shingle. Rows of one doc_id are one document to ``near_duplicates``; to ``without_copies``, which
deletes rows, they are one only if their texts agree too. Rows without doc_id take part in no search and get the
component of their fingerprint. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import column, prepared, slices, stored, whole_row
from windrow.llm.components import components

SEED = 42
# Texts hashed at a time in a task; each hash takes a hundred bytes while bits are counted.
SLICE_BYTES = 2 << 20
SHARD_ROWS = 4096
# Entries of a block of a larger shard; a task holds two of them. Rows of a block compared at a time.
BLOCK_ROWS, STRIP_ROWS = 4 * SHARD_ROWS, 16
# Near copies of a pipeline: shingles of five words, similarity 0.8. Sets of one size with that similarity have
# cosine 0.89 and differ in 155 of 1024 bits on average, with a deviation of 11; the radius is one deviation more, so
# that similarities down to about 0.77 are linked rather than any of 0.8 lost.
WIDE_BITS, WIDE_WORDS, WIDE_RADIUS = 1024, 5, 166
BANDS, BAND_ROWS = 14, 3
LEVELS = 3

# Eight counters of a byte each for the bits of a byte, least bit first.
SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed_hash(values: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (values + np.uint64(salt)) * ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words, A-Z lower-cased and joined by a blank; of all of them if there are fewer."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(parts) <= words:
        return [xxh64_intdigest(b" ".join(parts), SEED)] if parts else []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    pairs = zip(begins[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in pairs]


def bit_counts(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each of the 64 bits; runs begin at ``begins`` and none is empty."""
    rows = SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    # Byte counters are added up over 255 hashes at most, so none overflows.
    ends = np.append(begins[1:], len(hashes))
    pieces = (ends - begins + 254) // 255
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(begins, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    sums = np.add.reduceat(rows, cuts, axis=0).view(np.uint8).reshape(-1, 64)
    return np.add.reduceat(sums.astype(np.int64), first, axis=0)


def fingerprints_of(runs: list[list[int]], lanes: int) -> np.ndarray:
    """A fingerprint of ``lanes`` times 64 bits per run, as little-endian words; zero for an empty run."""
    out = np.zeros((len(runs), lanes), np.uint64)
    full = np.array([i for i, r in enumerate(runs) if r], np.int64)
    if not len(full):
        return out
    sizes = np.fromiter((len(runs[i]) for i in full), np.int64, len(full))
    flat = np.fromiter((h for r in runs for h in r), np.uint64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    for lane in range(lanes):
        counts = bit_counts(mixed_hash(flat, lane) if lane else flat, begins)
        bits = (2 * counts > sizes[:, None]).astype(np.uint8)
        out[full, lane] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def bands_of(runs: list[list[int]]) -> list[list[int] | None]:
    """Names of the bands of minimum hashes of each run; null for an empty one."""
    full = [i for i, r in enumerate(runs) if r]
    out: list[list[int] | None] = [None] * len(runs)
    if not full:
        return out
    sizes = np.fromiter((len(runs[i]) for i in full), np.int64, len(full))
    flat = np.fromiter((h for r in runs for h in r), np.uint64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    names = np.zeros((len(full), BANDS), np.uint64)
    for band in range(BANDS):
        name = np.full(len(full), band, np.uint64)
        for row in range(BAND_ROWS):
            least = np.minimum.reduceat(mixed_hash(flat, 1000 + band * BAND_ROWS + row), begins)
            name = mixed_hash(name ^ least, 7)
        names[:, band] = name
    for i, row in zip(full, names.view(np.int64).tolist(), strict=True):
        out[i] = row
    return out


def text_hash() -> Column:
    """What tells rows of one doc_id apart; null is a text of its own."""
    return F.xxhash64(F.col("text").cast("string"))


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, bands: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fingerprint)``, big-endian bytes, and bands and text hash if asked for."""
    prepared(docs.sparkSession)
    schema = "doc_id long, fingerprint binary" + (", bands array<long>, text_hash long" if bands else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            runs = [shingle_hashes(t, words) for t in column(part, "text").to_pylist()]
            prints = fingerprints_of(runs, lanes).astype(">u8")
            arrays = [column(part, "doc_id"), pa.array([r.tobytes() for r in prints], pa.binary())]
            names = ["doc_id", "fingerprint"]
            if bands:
                arrays += [pa.array(bands_of(runs), pa.list_(pa.int64())), column(part, "text_hash")]
                names += ["bands", "text_hash"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), *([text_hash().alias("text_hash")] if bands else [])
    )
    return rows.mapInArrow(run, schema)


class BKTree:
    """Integers under Hamming distance; children of a node are keyed by their distance to it."""

    def __init__(self):
        self.root: list | None = None

    def near(self, item: int, radius: int) -> list:
        """Payloads within the radius; edges whose key can't lead there are not followed."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            value, payload, children = open_nodes.pop()
            apart = (item ^ value).bit_count()
            if apart <= radius:
                found.append(payload)
            for key, child in children.items():
                if apart - radius <= key <= apart + radius:
                    open_nodes.append(child)
        return found

    def add(self, item: int, payload) -> None:
        """Adds an item; an equal one stays what it was."""
        if self.root is None:
            self.root = [item, payload, {}]
            return
        node = self.root
        while apart := (item ^ node[0]).bit_count():
            child = node[2].get(apart)
            if child is None:
                node[2][apart] = [item, payload, {}]
                return
            node = child


def shard_links(members: list[tuple[int, int]], radius: int) -> Iterator[tuple[int, int]]:
    """Links that hold the components of one shard's (fingerprint, node) together."""
    tree, head = BKTree(), {}

    def top(node: int) -> int:
        while head[node] != node:
            head[node] = head[head[node]]
            node = head[node]
        return node

    for item, node in members:
        head.setdefault(node, node)
        for other in tree.near(item, radius):
            a, b = top(node), top(other)
            if a != b:
                head[a] = b
                yield node, other
        tree.add(item, node)


def linked(shards: DataFrame, key: list[str], radius: int) -> DataFrame:
    """Links of all shards; rows of a shard come together in one task, one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, members, out = None, [], []

        def flush() -> None:
            if len(members) > 1:
                out.extend(shard_links(members, radius))

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in key), strict=True)
            prints, nodes = batch.column("fingerprint").to_pylist(), batch.column("node").to_pylist()
            for this, data, node in zip(keys, prints, nodes, strict=True):
                if this != name:
                    flush()
                    name, members = this, []
                members.append((int.from_bytes(data, "big"), node))
            if out:
                yield pairs(out)
                out = []
        flush()
        if out:
            yield pairs(out)

    together = shards.select(*key, "fingerprint", "node").repartition(*key).sortWithinPartitions(*key, "node")
    return together.mapInArrow(run, "a long, b long")


def pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["a", "b"])


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def thirds(mask: int) -> list[int]:
    """The mask with one third more of the bits it lacks, three times."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = -(-len(free) // 3)
    return [mask | mask_of(free[i * cut : (i + 1) * cut]) for i in range(3)]


def block_links(entries: DataFrame, most: int = SHARD_ROWS) -> DataFrame:
    """All links of 64-bit ``entries(fingerprint, node)`` within two bits, by shards that agree on whole blocks."""
    blocks = [mask_of(list(range(16 * i, 16 * i + 16))) for i in range(4)]
    masks = [a | b for a, b in combinations(blocks, 2)]
    value = F.conv(F.hex("fingerprint"), 16, -10).cast("long")
    rows = entries.withColumn("value", value)
    links = []

    def shard(number: int) -> Column:
        return F.struct(
            F.lit(number).alias("mask"), F.col("value").bitwiseAND(F.lit(signed(masks[number]))).alias("shard")
        )

    columns = ["fingerprint", "node", "value"]
    rows = rows.select(*columns, F.explode(F.array(*map(shard, range(len(masks))))).alias("at")).select(*columns, "at.*")
    for level in range(LEVELS):
        counts = rows.groupBy("mask", "shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        held = stored(rows.join(counts, ["mask", "shard"]), "shards")
        last = level == LEVELS - 1
        small = held if last else held.filter(F.col("n") <= most)
        links.append(linked(small, ["mask", "shard"], 2))
        large = held.filter(F.col("n") > most).select(*columns, "mask")
        if last or large.isEmpty():
            break
        # A shard of mask i goes on by the masks 3 i to 3 i + 2.
        masks = [t for m in masks for t in thirds(m)]
        choices = F.array(*[F.array(*map(shard, range(i, i + 3))) for i in range(0, len(masks), 3)])
        further = large.select(*columns, F.explode(F.element_at(choices, F.col("mask") + 1)).alias("at"))
        rows = further.select(*columns, "at.*")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def band_links(entries: DataFrame, radius: int, most: int = SHARD_ROWS) -> DataFrame:
    """Links of ``entries(fingerprint, node, bands)`` within the radius that share bands of minimum hashes.

    They hold the same components together whatever ``most`` is, the entries of a shard from which on it is cut.
    """
    rows = entries.select("node", F.explode("bands").alias("shard"))
    prints = entries.select("node", "fingerprint")
    # Most bands hold one entry. Numbers alone tell which hold more, and fingerprints go only to these.
    # One entry of a shard, by a draw of its own in each shard, is the pivot.
    draw = F.xxhash64("node", "shard")
    counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", draw).alias("pivot")).filter("n > 1")
    held = stored(rows.join(counts, "shard").join(prints, "node"), "shards")
    links = linked(held.filter(F.col("n") <= most), ["shard"], radius)
    large = held.filter(F.col("n") > most)
    if large.isEmpty():
        return links
    pivots = large.filter(F.col("node") == F.col("pivot")).select("shard", F.col("fingerprint").alias("pivot_print"))
    measured = distance_to("pivot_print")(large.join(pivots, "shard"))
    measured = stored(measured.withColumn("far", F.col("apart") > radius), "pivots")
    at_pivot = measured.filter(~F.col("far")).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    return links.unionByName(at_pivot).unionByName(block_pair_links(measured, radius, most * BLOCK_ROWS // SHARD_ROWS))


def block_pair_links(measured: DataFrame, radius: int, size: int) -> DataFrame:
    """Links of large shards' ``(shard, fingerprint, node, far)`` by pairs of blocks of about ``size`` entries.

    Blocks of entries at the pivot have negative numbers and meet only those of entries that are far from it.
    """
    sizes = measured.groupBy("shard").agg(F.count_if("far").alias("n_far"), F.count_if(~F.col("far")).alias("n_at"))
    n_far, n_at = (F.ceil(F.col(n) / size).cast("int") for n in ("n_far", "n_at"))
    sizes = sizes.filter("n_far > 0").select("shard", n_far.alias("far_blocks"), n_at.alias("at_blocks"))
    draw = F.xxhash64("node", F.lit(SEED))
    own = F.when(F.col("far"), F.pmod(draw, F.col("far_blocks"))).otherwise(-1 - F.pmod(draw, F.col("at_blocks")))
    others = F.sequence(F.when(F.col("far"), -F.col("at_blocks")).otherwise(0), F.col("far_blocks") - 1)
    dealt = (
        measured.join(sizes, "shard")
        .select("shard", "fingerprint", "node", own.cast("int").alias("block"), F.explode(others).alias("other"))
        .select("shard", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fingerprint", "node")
    )
    key = ["shard", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, members = None, []

        def found() -> Iterator[pa.RecordBatch]:
            if members:
                prints, nodes, upper = (np.concatenate(x) for x in zip(*members, strict=True))
                out = far_links(prints, nodes, upper, name[1] == name[2], radius)
                if out:
                    yield pairs(out)

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in key], axis=1)
            prints = np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), np.uint64).reshape(len(keys), -1)
            nodes = batch.column("node").to_numpy()
            upper = batch.column("block").to_numpy() == keys[:, 2]
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if end > begin:
                    this = tuple(keys[begin].tolist())
                    if this != name:
                        yield from found()
                        name, members = this, []
                    members.append((prints[begin:end], nodes[begin:end], upper[begin:end]))
        yield from found()

    together = dealt.repartition(*key).sortWithinPartitions(*key, "node")
    return together.mapInArrow(run, "a long, b long")


def far_links(prints: np.ndarray, nodes: np.ndarray, upper: np.ndarray, alone: bool, radius: int) -> list[tuple[int, int]]:
    """Links that hold the components of one block, or of the pairs between a lower and an upper one, together.

    Half of the words tell most pairs apart; the others are read for what is left and not yet in one component.
    """
    left = np.arange(len(nodes)) if alone else np.flatnonzero(~upper)
    right = left if alone else np.flatnonzero(upper)
    label, half, out = np.arange(len(nodes)), prints.shape[1] // 2, []
    words = np.ascontiguousarray(prints[right].T)
    for at in range(0, len(left), STRIP_ROWS):
        strip = left[at : at + STRIP_ROWS]
        apart = np.zeros((len(strip), len(right)), np.uint16)
        for lane in range(half):
            apart += np.bitwise_count(prints[strip, lane][:, None] ^ words[lane])
        near = apart <= radius
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            one = strip[k]
            open_ones = np.flatnonzero(near[k])
            open_ones = open_ones[label[right[open_ones]] != label[one]]
            more = np.bitwise_count(prints[one, half:] ^ prints[right[open_ones], half:]).sum(axis=1, dtype=np.int64)
            for other in right[open_ones[apart[k, open_ones] + more <= radius]].tolist():
                if label[other] != label[one]:
                    label[label == label[other]] = label[one]
                    out.append((int(nodes[one]), int(nodes[other])))
    return out


def distance_to(other: str) -> Callable[[DataFrame], DataFrame]:
    """Adds ``apart``, the differing bits of two columns of bytes."""

    def bits(frame: DataFrame) -> DataFrame:
        words = [
            F.bit_count(
                F.conv(F.hex(F.substring("fingerprint", 8 * i + 1, 8)), 16, -10)
                .cast("long")
                .bitwiseXOR(F.conv(F.hex(F.substring(other, 8 * i + 1, 8)), 16, -10).cast("long"))
            )
            for i in range(WIDE_BITS // 64)
        ]
        return frame.withColumn("apart", sum(words[1:], words[0]))

    return bits


def entries_of(prints: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct fingerprint once, named by its smallest document."""
    return prints.filter(F.col("doc_id").isNotNull()).groupBy(*keys).agg(F.min("doc_id").alias("node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of 3-word shingles, 64 bits and radius 2; a row per row of ``docs``."""
    prints = stored(fingerprints(docs), "fingerprints")
    entries = stored(entries_of(prints, ["fingerprint"]), "entries")
    groups = stored(components(block_links(entries)), "components")
    named = entries.join(groups, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fingerprint", "left").select(
        "doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id"
    )


def copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash)`` of documents that have a smaller one in their group of near copies."""
    prints = stored(fingerprints(docs, WIDE_WORDS, WIDE_BITS // 64, bands=True), "fingerprints")
    prints = prints.filter(F.col("doc_id").isNotNull()).withColumn("node", F.xxhash64("fingerprint", "bands"))
    # An entry has a name of its own, as texts of one doc_id may be several entries.
    here = F.struct("doc_id", "text_hash")
    entries = prints.groupBy("fingerprint", "bands", "node").agg(F.min(here).alias("first"))
    entries = stored(entries, "entries")
    groups = stored(components(band_links(entries, WIDE_RADIUS)), "components")
    heads = entries.select("node", "first").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = heads.groupBy("group").agg(F.min("first").alias("stays"))
    return (
        prints.select("node", here.alias("document"))
        .join(heads.join(least, "group").select("node", "stays"), "node")
        .filter(F.col("document") != F.col("stays"))
        .select("document.*")
        .distinct()
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of one id that with the smallest hash.

    Of rows that agree in both, one stays. Rows without id stay.
    """
    drop = stored(copies(docs), "copies")
    # The same join at every size: what is dropped grows with the documents.
    drop = drop.select(F.col("doc_id").alias("dropped"), F.col("text_hash").alias("dropped_hash")).hint("merge")
    same = (docs["doc_id"] == drop["dropped"]) & (text_hash() == drop["dropped_hash"])
    kept = docs.join(drop, same, "left_anti")
    rows = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if rows.filter("n > 1").isEmpty():
        return kept
    # The row with the smallest hash of all it holds; maps have none.
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    every = F.xxhash64(*["`" + c.replace("`", "``") + "`" for c in plain])
    named = kept.filter(F.col("doc_id").isNotNull())
    named = named.select(F.col("doc_id").alias("id"), text_hash().alias("hash"), every.alias("draw"), whole_row(named))
    named = named.groupBy("id", "hash").agg(F.min_by("row", "draw").alias("row")).select("row.*")
    return named.unionByName(kept.filter(F.col("doc_id").isNull()))
