"""What several operators of this subpackage share: scratch tables, bounded slices of Arrow batches, words."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# White space that separates words: [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"
# A word of the lower-cased form: letters, digits and everything beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Texts handled at a time inside a task. A longer text is handled alone, and whole.
SLICE_BYTES = 4 << 20
# Rows of an Arrow batch; with texts of a megabyte a batch is still small beside an executor.
BATCH_ROWS = 1000
SHIPPED: set[str] = set()
ROOTS: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only on a single-machine session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is not set; name a folder that every executor can reach")
    return f"file://{tempfile.gettempdir()}"


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; all of an application's go when its JVM ends."""
    root = f"{shared_root(spark)}/windrow-{spark.sparkContext.applicationId}"
    if root not in ROOTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        ROOTS.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    # Shuffle files of what is now stored go when the driver collects its garbage, which it may not do for long.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(frame.schema).parquet(path)


def prepared(spark: SparkSession) -> None:
    """Readies a session for operators that run Python in tasks.

    Arrow batches get fewer rows, so that a batch of long texts stays small. The package goes to the executors as a
    Python archive, once for each application, so that tasks find it wherever the driver was started.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    application = spark.sparkContext.applicationId
    if application in SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    archive_uri = f"{scratch(spark, 'package')}.zip"
    system, path = fs.FileSystem.from_uri(archive_uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(archive_uri)
    SHIPPED.add(application)


def whole_row(frame: DataFrame) -> Column:
    """All columns of a frame as one, so that they travel beside an operator's own whatever they are called."""
    names = ["`" + c.replace("`", "``") + "`" for c in frame.columns]
    return F.struct(*map(F.col, names)).alias("row")


def schema_with(carried: list[StructField], more: str) -> StructType:
    """Fields of a frame and further ones."""
    return StructType([*carried, *StructType.fromDDL(more).fields])


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Consecutive rows of the batches with about ``limit`` bytes of text; at least one row each."""
    waiting, held = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        begun = done = 0
        while begun < batch.num_rows:
            stop = max(begun + 1, int(np.searchsorted(ends, done + limit - held, "right")))
            if waiting and held + int(ends[min(stop, batch.num_rows) - 1]) - done > limit:
                yield pa.Table.from_batches(waiting)
                waiting, held = [], 0
                continue
            stop = min(stop, batch.num_rows)
            waiting.append(batch.slice(begun, stop - begun))
            held += int(ends[stop - 1]) - done
            begun, done = stop, int(ends[stop - 1])
            if held >= limit or begun < batch.num_rows:
                yield pa.Table.from_batches(waiting)
                waiting, held = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a slice as one array."""
    chunked = table.column(name)
    return chunked.chunk(0) if chunked.num_chunks == 1 else pa.concat_arrays(chunked.chunks or [pa.array([], chunked.type)])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts one after another, and the row of each. Null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = pc.list_flatten(lists)
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(words), 0)
    if pc.all(full).as_py() is False:
        words = words.filter(full)
        rows = rows[full.to_numpy(zero_copy_only=False)]
    return words, rows


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How many entries, or their weights' whole-number sum, each row has."""
    return np.rint(np.bincount(rows, weights, minlength=n)).astype(np.int64)
