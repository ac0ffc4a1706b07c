"""Exact substring dedup: every byte covered by a 100-byte string that also starts earlier is removed.

A suffix array of the whole corpus fits no machine, so the corpus is first dealt into pieces between which no match can
be lost, and each piece gets its suffix array (see ``suffix_array``):

1. Each 100-byte window has an anchor, the 32-byte string in it with the least hash. Equal windows have equal anchors.
   Consecutive windows with one anchor are a context of up to 168 bytes, about one for 34 bytes of text; only its
   hashes and place are shuffled.
2. Contexts whose anchor occurs once hold no repeat and are dropped. Of equal contexts, all but the first are later
   copies as a whole, found by an aggregation and a join; however many copies there are, they are never gathered.
3. What is left are different contexts around one anchor. Their bytes are cut to what any two of them share, and the
   contexts of an anchor go into one text, whose suffix array by linear grouping puts equal windows side by side. All
   windows but the first of such a run are later copies.
4. An anchor with more than ``MOST_CONTEXTS`` different contexts would make an unbounded text. Its windows are instead
   aggregated by their own 128-bit hashes, which gives the same result at more cost.
5. The spans of a document are merged and cut out.

Defined results: null and empty texts have 0 bytes and nothing is removed; nor is it from texts below 100 bytes. A null
doc_id comes before all others. Rows that agree in doc_id and text are one document, rows of one doc_id with different
texts are ordered by a checksum of the text. Extra columns are left out. Texts of any length are worked on in segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import column, prepared, slices, stored
from windrow.llm.suffix_array import suffix_array

LENGTH = 100
GRAM = 32
MOST_CONTEXTS = 2000
TEXT_BYTES = 1 << 16
SEGMENT = 1 << 21
NO_ID = -(1 << 63)
ANCHORS = "id long, tie long, anchor long, context long, begin long, size int, shift int"
SPANS = "id long, tie long, begin long, stop long"
PLACE = (1 << 31) - 1  # bits of a key that hold the place, so that the first of equal hashes wins
ODD = 0x9E3779B97F4A7C15
BYTE_HASHES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the string of ``size`` bytes, a power of two, at each place."""
    out, factor, width = BYTE_HASHES[data], ODD, 1
    with np.errstate(over="ignore"):
        while width < size:
            out = out[:-width] * np.uint64(factor) + out[width:]
            factor, width = factor * factor % (1 << 64), 2 * width
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def contexts(data: np.ndarray, piece: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor hash, anchor place, and first and last window of each context; windows lie inside one piece."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty, empty, empty
    hashes = gram_hashes(data)
    least = (hashes & np.uint64((1 << 64) - 1 - PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    width, wanted = 1, length - GRAM + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    windows = np.flatnonzero(piece[: len(least)] == piece[length - 1 : length - 1 + len(least)])
    if not len(windows):
        return empty.astype(np.uint64), empty, empty, empty
    anchor = (least[windows] & np.uint64(PLACE)).astype(np.int64)
    cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
    first, last = np.append(0, cuts), np.append(cuts, len(windows)) - 1
    return hashes[anchor[first]], anchor[first], windows[first], windows[last]


def segments(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Pieces of texts, with the row and offset of each, about ``SEGMENT`` bytes at a time.

    A long text is cut so that each of its windows lies in exactly one piece.
    """
    pieces: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    held = 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), SEGMENT):
            piece = text[at : at + SEGMENT + LENGTH - 1]
            if held and held + len(piece) > SEGMENT:
                yield pieces, rows, offsets
                pieces, rows, offsets, held = [], [], [], 0
            pieces.append(piece)
            rows.append(row)
            offsets.append(at)
            held += len(piece)
    if pieces:
        yield pieces, rows, offsets


def anchored(docs: DataFrame, with_contexts: bool) -> DataFrame:
    """A row per context of ``docs(id, tie, text)``; only its anchor if the rest isn't asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for part in slices(batches, "text", SEGMENT):
            ids = column(part, "id").to_numpy(zero_copy_only=False)
            ties = column(part, "tie").to_numpy(zero_copy_only=False)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in column(part, "text").to_pylist()]
            for pieces, rows, offsets in segments(texts):
                joined = b"".join(pieces)
                sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
                piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
                hashes, place, first, last = contexts(np.frombuffer(joined, np.uint8), piece)
                if not len(first):
                    continue
                anchor = pa.array(hashes.view(np.int64))
                if not with_contexts:
                    yield pa.RecordBatch.from_arrays([anchor], names=["anchor"])
                    continue
                spans = zip(first.tolist(), (last + LENGTH).tolist(), strict=True)
                digest = np.fromiter((xxh3_64_intdigest(joined[a:b]) for a, b in spans), np.uint64, len(first))
                own = piece[first]
                row = np.array(rows)[own]
                begin = first - (np.cumsum(sizes) - sizes)[own] + np.array(offsets)[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[row]),
                        pa.array(ties[row]),
                        anchor,
                        pa.array(digest.view(np.int64)),
                        pa.array(begin),
                        pa.array((last - first + LENGTH).astype(np.int32)),
                        pa.array((place - first).astype(np.int32)),
                    ],
                    names=[x.split(" ")[0] for x in ANCHORS.split(", ")],
                )

    return docs.mapInArrow(run, ANCHORS if with_contexts else "anchor long")


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def longest_shared(strings: list[bytes]) -> list[int]:
    """The longest prefix that each string shares with any other one."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for i, j in zip(order, order[1:], strict=False):
        n = shared_prefix(strings[i], strings[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def trimmed(group: list[tuple]) -> list[tuple]:
    """Contexts of one anchor, ``(id, tie, begin, shift, data)``, cut to what some other one of them shares.

    What two contexts share around the anchor reaches to where they first differ on either side.
    """
    right = longest_shared([data[shift:] for *_, shift, data in group])
    left = longest_shared([data[: shift + GRAM][::-1] for *_, shift, data in group])
    out = []
    for (doc, tie, begin, shift, data), a, b in zip(group, left, right, strict=True):
        start, stop = shift + GRAM - a, shift + b
        if stop - start >= LENGTH:
            out.append((doc, tie, begin + start, data[start:stop]))
    return out


def repeated_windows(group: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """Spans of ``(id, tie, begin, data)`` covered by windows that start earlier in another place of the group."""
    text = bytearray()
    owner: list[int] = []
    base = []
    for number, (*_, data) in enumerate(group):
        base.append(len(text))
        text += data
        text.append(0)
        owner += [number] * (len(data) + 1)
    symbols = bytes(text)
    ends = [b + len(data) for b, (*_, data) in zip(base, group, strict=True)]
    whole = [i for i in suffix_array(symbols) if i + LENGTH <= ends[owner[i]]]

    def start(i: int) -> tuple[int, int, int]:
        doc, tie, begin, _ = group[owner[i]]
        return doc, tie, begin + i - base[owner[i]]

    def copies(run: list[int]) -> Iterator[tuple[int, int, int]]:
        if len(run) > 1:
            places = [start(i) for i in run]
            earliest = min(places)
            yield from (p for p in places if p != earliest)

    later: list[tuple[int, int, int]] = []
    run: list[int] = []
    for i in whole:
        if run and symbols[run[-1] : run[-1] + LENGTH] != symbols[i : i + LENGTH]:
            later += copies(run)
            run = []
        run.append(i)
    later += copies(run)
    yield from joined_windows(sorted(later))


def joined_windows(starts: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Sorted window starts as spans; windows that touch are one."""
    span = None
    for doc, tie, begin in starts:
        if span and span[:2] == (doc, tie) and begin <= span[3]:
            span = (doc, tie, span[2], max(span[3], begin + LENGTH))
        else:
            if span:
                yield span
            span = (doc, tie, begin, begin + LENGTH)
    if span:
        yield span


def in_arrays(rows: DataFrame) -> DataFrame:
    """Spans found by the suffix arrays of all anchors' contexts; small groups share a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, group, text, held = None, [], [], 0
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "id", "tie", "begin", "shift", "data")]
            for anchor, *row in zip(*columns, strict=True):
                if anchor != name:
                    if len(group) > 1:
                        cut = trimmed(group)
                        text += cut
                        held += sum(len(x[-1]) for x in cut)
                    name, group = anchor, []
                    if held >= TEXT_BYTES:
                        out += repeated_windows(text)
                        text, held = [], 0
                group.append(tuple(row))
            if out:
                yield spans_batch(out)
                out = []
        text += trimmed(group) if len(group) > 1 else []
        out += repeated_windows(text) if text else []
        if out:
            yield spans_batch(out)

    dealt = rows.select("anchor", "id", "tie", "begin", "shift", "data").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, SPANS)


def spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in SPANS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)


def by_window(rows: DataFrame) -> DataFrame:
    """The same spans for anchors with many contexts, by aggregating the windows' own hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("id", "tie", "begin", "data")]
            for doc, tie, begin, data in zip(*columns, strict=True):
                for i in range(len(data) - LENGTH + 1):
                    out.append((doc, tie, begin + i, xxh3_128_digest(data[i : i + LENGTH])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["id", "tie", "begin", "window"],
                )

    windows = stored(
        rows.select("id", "tie", "begin", "data").mapInArrow(run, "id long, tie long, begin long, window binary"), "windows"
    )
    here = F.struct("id", "tie", "begin")
    first = stored(windows.groupBy("window").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "firsts")
    later = windows.join(first, "window").filter(here != F.col("first"))
    return later.select("id", "tie", "begin", (F.col("begin") + LENGTH).alias("stop"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``id`` and ``tie``, which order documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.crc32(text).alias("tie"),
        text.alias("text"),
    )


def repeated_spans(docs: DataFrame, most: int = MOST_CONTEXTS) -> DataFrame:
    """``(id, tie, begin, stop)`` of bytes in strings that start earlier; spans may overlap."""
    texts = keyed(docs).select("id", "tie", "text")
    shared = anchored(texts, False).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    shared = stored(shared, "anchors")
    found = stored(anchored(texts, True).join(shared, "anchor"), "contexts")

    first = F.struct("id", "tie", "begin", "size", "shift")
    firsts = stored(found.groupBy("anchor", "context").agg(F.min(first).alias("first")), "firsts")
    whole = (
        found.join(firsts, ["anchor", "context"])
        .filter(F.struct("id", "tie", "begin") != F.struct("first.id", "first.tie", "first.begin"))
        .select("id", "tie", "begin", (F.col("begin") + F.col("size")).alias("stop"))
    )
    many = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    different = firsts.join(many, "anchor").select("anchor", "n", "first.*")
    data = F.substring(F.col("text").cast("binary"), F.col("begin").cast("int") + 1, F.col("size"))
    different = stored(
        different.join(texts, ["id", "tie"]).select("anchor", "n", "id", "tie", "begin", "shift", data.alias("data")), "different"
    )
    spans = whole.unionByName(in_arrays(different.filter(F.col("n") <= most)))
    large = different.filter(F.col("n") > most)
    if not large.isEmpty():
        spans = spans.unionByName(by_window(large))
    return spans


def deduplicated(docs: DataFrame, most: int = MOST_CONTEXTS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: bytes of the text, what is kept of them, and the removed runs.

    What is kept is bytes, as a run may begin or end inside a character.
    """
    prepared(docs.sparkSession)
    per_doc = repeated_spans(docs, most).groupBy("id", "tie").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))
    per_doc = stored(per_doc, "spans")
    rows = keyed(docs).join(per_doc, ["id", "tie"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            kept, runs, sizes = [], [], []
            texts, spans = column(part, "text").to_pylist(), column(part, "spans").to_pylist()
            for text, own in zip(texts, spans, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                merged = merge(own or [])
                out, at = [], 0
                for begin, stop in merged:
                    out.append(data[at:begin])
                    at = stop
                kept.append(b"".join([*out, data[at:]]))
                runs.append([{"begin": a, "stop": b} for a, b in merged])
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, kind)],
                names=["doc_id", "n_bytes", "kept", "runs"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, kept binary, runs array<struct<begin: long, stop: long>>")


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for begin, stop in sorted((s["begin"], s["stop"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((begin, stop))
    return out
