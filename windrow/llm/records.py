"""Token ids as length-delimited binary records.

Documents are dealt out in ranges of their id, sorted, encoded, and each range is written as one data file and one index
file in a shared folder. A record is framed as

    length of the payload (8 bytes) | masked checksum of these 8 bytes (4) | payload | masked checksum of the payload (4)

all little-endian. A masked checksum is CRC-32 turned right by 15 bits plus a constant, so that files of records can
be stored as records again. The payload is one flag byte (1: the document has an id, 2: ids take 4 bytes instead of 2),
the document's id (8 bytes) and the token ids. The index file holds (document id, byte offset, number of ids) as three
8-byte integers for each record, so that a reader can visit records in any order.

A file's name carries the attempt that wrote it, and only the files named in the manifest count: a task that is run
again, or twice at a time, can't damage what is there. The manifest is itself a stored table, with a row per file.

Defined results: null and empty texts are records of the end id alone. Rows without a document id come first. Rows
with the same id are ordered by text and kept as records of their own. An empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import column, prepared, scratch, slices, split_words, stored

END_ID = 2
HAS_ID, WIDE = 1, 2
MASK_DELTA = 0xA282EAD8  # fixed value of the masked checksum
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
CACHE_WORDS = 500_000
GROUP_WORDS = 1000
# Letters below U+0250, but for one whose lower case is two characters, and ASCII that is no letter.
PLAIN_WORD = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<tail>[!-@\[-`{-~]*)$"
READ_BYTES = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join(
        (length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)))
    )


def unframe(data: memoryview, at: int) -> tuple[memoryview, int] | None:
    """The payload at ``at`` and where the next record begins; None if the record isn't all there."""
    if at + 12 > len(data):
        return None
    (size,) = struct.unpack_from("<Q", data, at)
    if struct.unpack_from("<I", data, at + 8)[0] != masked(bytes(data[at : at + 8])):
        raise ValueError("damaged record: checksum of the length")
    end = at + 12 + size
    if end + 4 > len(data):
        return None
    payload = data[at + 12 : end]
    if struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError("damaged record: checksum of the payload")
    return payload, end + 4


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = (HAS_ID if doc_id is not None else 0) | (WIDE if wide else 0)
    return struct.pack("<Bq", flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return doc_id if flags & HAS_ID else None, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=9)


class WordEncoder:
    """Encodes texts word by word and remembers a bounded number of words.

    Splitting a text at ASCII white space doesn't change its ids for a vocabulary whose pre-tokeniser drops white space
    and whose normaliser doesn't reach across it; the special tokens hold none either. Plain words, letters below U+0250
    followed by ASCII that is no letter, are cut once more behind the letters, where the pre-tokeniser cuts too, and
    their letters are encoded many at a time and told apart by the pieces that end a word. All others go in whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        ends = [t.endswith("</w>") for t, _ in sorted(self.model.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends)
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {"": 0}
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, one after another, and how many each has."""
        flat, sizes = [], []
        for at in range(0, len(words), GROUP_WORDS):
            group = words[at : at + GROUP_WORDS]
            ids = np.array(self.whole([" ".join(group)])[0], np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(group) and last[-1] == len(ids) - 1:
                flat.append(ids)
                sizes.append(np.diff(last, prepend=-1))
            else:
                each = self.whole(group)
                flat.append(np.array([i for x in each for i in x], np.uint32))
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(flat), np.concatenate(sizes)

    def remember(self, words: list[str], plain: bool) -> None:
        fresh = [w for w in words if w not in self.places]
        if not fresh:
            return
        if plain:
            flat, sizes = self.letters(fresh)
        else:
            each = self.whole(fresh)
            flat = np.array([i for x in each for i in x], np.uint32)
            sizes = np.fromiter(map(len, each), np.int64, len(each))
        self.places.update(zip(fresh, range(len(self.places), len(self.places) + len(fresh)), strict=True))
        self.flat, self.sizes = np.append(self.flat, flat), np.append(self.sizes, sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if len(self.places) > CACHE_WORDS:
            self.forget()
        words, rows = split_words(texts)
        coded = words.dictionary_encode()
        cut = pc.extract_regex(coded.dictionary, PLAIN_WORD)
        heads = pc.ascii_lower(pc.fill_null(cut.field(0), "").cast(pa.string())).dictionary_encode()
        tails = pc.coalesce(pc.if_else(cut.is_valid(), cut.field(1), None), coded.dictionary).dictionary_encode()
        first, second = self.look_up(heads, plain=True), self.look_up(tails, plain=False)

        # Each word of the dictionary as two runs of ids, then each word of the texts.
        begins = np.cumsum(self.sizes) - self.sizes
        parts = np.stack([first, second], axis=1)[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        sizes = self.sizes[parts]
        ids = self.flat[np.repeat(begins[parts] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        counts = np.bincount(rows, sizes.reshape(-1, 2).sum(axis=1), len(texts)).astype(np.int64)
        return ids, counts

    def look_up(self, words: pa.DictionaryArray, plain: bool) -> np.ndarray:
        """Places of the words, which are encoded first if they are new."""
        distinct = words.dictionary.to_pylist()
        self.remember([w for w in distinct if w], plain)
        at = np.fromiter((self.places[w] for w in distinct), np.int64, len(distinct))
        return at[words.indices.to_numpy(zero_copy_only=False)]


ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One of a worker process, kept between its tasks."""
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


def opened(uri: str):
    """File system and path of a URI, by the libraries that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get()
    name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
    words = encoder(tokenizer)
    data = index = None
    offset = n_docs = n_tokens = 0
    for part in slices(batches, "text"):
        if data is None:
            system, path = opened(f"{name}.rec")
            data = system.open_output_stream(path)
            index = system.open_output_stream(path[: -len("rec")] + "idx")
        ids, counts = words.encode(column(part, "text"))
        ends = np.cumsum(counts)
        out, entries = [], []
        for doc_id, end, count in zip(column(part, "doc_id").to_pylist(), ends.tolist(), counts.tolist(), strict=True):
            out.append(frame(pack(doc_id, np.append(ids[end - count : end], np.uint32(end_id)))))
            entries.append((doc_id or 0, offset, count + 1))
            offset += len(out[-1])
        data.write(b"".join(out))
        index.write(np.array(entries, "<i8").tobytes())
        n_docs += len(entries)
        n_tokens += int(counts.sum()) + len(entries)
    if data is not None:
        data.close()
        index.close()
        row = [[task.partitionId()], [f"{name}.rec"], [n_docs], [n_tokens]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["shard", "path", "n_docs", "n_tokens"]
        )


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes every row of ``docs(doc_id, text)`` in ascending order of id; returns the stored manifest."""
    spark = docs.sparkSession
    prepared(spark)
    folder = folder or scratch(spark, "records")
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shards = (
        rows.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(lambda batches: write_shard(batches, folder, tokenizer, end_id), MANIFEST)
    )
    return stored(shards, "manifest")


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of a file in turn; holds one record and a block of the file."""
    system, name = opened(path)
    rest = b""
    with system.open_input_stream(name) as file:
        while block := file.read(READ_BYTES):
            data, at = memoryview(rest + block if rest else block), 0
            while found := unframe(data, at):
                payload, at = found
                yield unpack(payload)
            rest = bytes(data[at:])
    if rest:
        raise ValueError(f"{path}: ends inside a record")


def read_at(path: str, offset: int) -> tuple[int | None, np.ndarray]:
    """The record at an offset that the index names."""
    system, name = opened(path)
    with system.open_input_file(name) as file:
        head = file.read_at(12, offset)
        size = struct.unpack("<Q", head[:8])[0]
        payload, _ = unframe(memoryview(file.read_at(size + 16, offset)), 0)
    return unpack(payload)


def read_index(path: str) -> np.ndarray:
    """(document id, offset, number of ids) of each record of a data file."""
    system, name = opened(path[: -len("rec")] + "idx")
    with system.open_input_stream(name) as file:
        return np.frombuffer(file.read(), "<i8").reshape(-1, 3)


def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            rows: list[tuple] = []
            for doc_id, ids in read_file(path):
                rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                base += len(ids)
                if len(rows) == 10_000:
                    yield digest(rows)
                    rows = []
            if rows:
                yield digest(rows)


def digest(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row per record, read back from the files: id, ids before it, ids, and their checksum.

    The manifest has a row per file, so the files' starts are summed in the driver.
    """
    files, base = [], 0
    for row in manifest.orderBy("shard").collect():
        files.append((row.path, base))
        base += row.n_tokens
    paths = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return paths.mapInArrow(read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")
