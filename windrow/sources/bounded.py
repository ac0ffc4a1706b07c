"""A stream source with an admission limit in records, and a sink whose batches appear at once, as Python data sources.

``BoundedFiles`` reads a folder of Parquet files in the order of their names. Its offset is a file and how many of its
records are done, so a trigger takes at most ``recordsPerTrigger`` records even if a file holds more, and a checkpoint
goes on in the middle of a file. The driver reads file names and footers only; tasks read pieces of row groups.

``CommittedBatches`` writes each task's rows to a file of its own and makes a batch visible by one small list of these
files. A batch that is written again after a failure finds its list and leaves the first copy as it is; files without
a list, such as those of a task that died, are never read.

Defined results: an empty folder is an empty stream, if a schema is given; a file without records is passed over; an
empty batch is a list without files; repeated records and nulls are records like any other. Columns of a file that
are not in the schema are not read, and missing ones are an error. Names must grow, as those that carry their hour do:
a file that arrives under a smaller name than one already read is not seen. The source has no end of its own: a query
over it runs by a processing-time trigger, as ``availableNow`` would stop after one admission. A folder of batches
belongs to one query, as its batch numbers do.

Folders are opened by Arrow's file systems, which tell local paths and object stores by their URI.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

# Executors need not have this package: the classes travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIST_SCHEMA = "batch long, n_rows long, files array<string>"
READ_ROWS = 10_000


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    files, inner = pafs.FileSystem.from_uri(path)
    return files, inner.rstrip("/")


def file_names(path: str) -> list[str]:
    """Parquet files below a folder, by name; hidden ones are somebody's work in progress."""
    files, base = opened(path)
    found = files.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
    names = (i.path[len(base) + 1 :] for i in found if i.type == pafs.FileType.File and i.path.endswith(".parquet"))
    return sorted(n for n in names if not any(part[0] in "_." for part in n.split("/")))


class BoundedFiles(DataSource):
    """Options: ``path``, and ``recordsPerTrigger``, without which a trigger takes all there is."""

    @classmethod
    def name(cls) -> str:
        return "windrow_bounded_files"

    def schema(self) -> StructType:
        names = file_names(self.options["path"])
        if not names:
            raise ValueError(f"{self.options['path']} holds no file to take a schema from; give one")
        files, base = opened(self.options["path"])
        return from_arrow_schema(pq.read_schema(f"{base}/{names[0]}", filesystem=files))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        limit = self.options.get("recordsPerTrigger")
        return BoundedReader(self.options["path"], schema, None if limit is None else int(limit))


class BoundedReader(DataSourceStreamReader):
    BEGIN = {"file": "", "records": 0}

    def __init__(self, path: str, schema: StructType, limit: int | None):
        if limit is not None and limit < 1:
            raise ValueError("recordsPerTrigger must be at least 1")
        self.path, self.fields, self.limit = path, schema, limit
        self.position = dict(self.BEGIN)

    def initialOffset(self) -> dict:
        return dict(self.BEGIN)

    def latestOffset(self) -> dict:
        """The end of what one trigger may take from where the last one ended.

        It stays the same until that is planned, however often it is asked for.
        """
        files, base = opened(self.path)
        here, room = dict(self.position), self.limit
        for name in file_names(self.path):
            if name < here["file"]:
                continue
            done = here["records"] if name == here["file"] else 0
            left = pq.read_metadata(f"{base}/{name}", filesystem=files).num_rows - done
            taken = left if room is None else min(left, room)
            if taken > 0:
                here = {"file": name, "records": done + taken}
            if room is not None:
                room -= taken
                if room == 0:
                    break
        return here

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Pieces of row groups between two offsets. A restarted query names its offset here before it goes on."""
        if (end["file"], end["records"]) < (start["file"], start["records"]):
            raise ValueError(f"the stream is at {start}, beyond {end}")
        self.position = dict(end)
        if start == end:
            return []
        files, base = opened(self.path)
        pieces = []
        for name in file_names(self.path):
            if not start["file"] <= name <= end["file"]:
                continue
            footer = pq.read_metadata(f"{base}/{name}", filesystem=files)
            low = start["records"] if name == start["file"] else 0
            high = end["records"] if name == end["file"] else footer.num_rows
            begin = 0
            for group in range(footer.num_row_groups):
                size = footer.row_group(group).num_rows
                a, b = max(low - begin, 0), min(high - begin, size)
                if a < b:
                    pieces.append(InputPartition((name, group, a, b)))
                begin += size
        return pieces

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, group, low, high = partition.value
        files, base = opened(self.path)
        target = to_arrow_schema(self.fields)
        with files.open_input_file(f"{base}/{name}") as source:
            at = 0
            rows = pq.ParquetFile(source).iter_batches(READ_ROWS, row_groups=[group], columns=target.names)
            for batch in rows:
                a, b = max(low - at, 0), min(high - at, batch.num_rows)
                at += batch.num_rows
                if a < b:
                    yield from pa.table(batch.slice(a, b - a)).select(target.names).cast(target).to_batches()
                if at >= high:
                    break


class CommittedBatches(DataSource):
    """Option: ``path``."""

    @classmethod
    def name(cls) -> str:
        return "windrow_committed_batches"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return BatchWriter(self.options["path"], schema)


class BatchWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.fields = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """A file of a name nobody else has; none if there are no rows."""
        files, base = opened(self.path)
        target = to_arrow_schema(self.fields)
        message = WriterCommitMessage()
        message.name, message.n_rows = f"{uuid.uuid4().hex}.parquet", 0
        writer = None
        for batch in iterator:
            if batch.num_rows:
                if writer is None:
                    files.create_dir(f"{base}/data", recursive=True)
                    writer = pq.ParquetWriter(f"{base}/data/{message.name}", target, filesystem=files)
                writer.write_table(pa.Table.from_batches([batch]).cast(target))
                message.n_rows += batch.num_rows
        if writer is not None:
            writer.close()
        return message

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        """Makes a batch visible, unless it is already."""
        files, base = opened(self.path)
        written = [m for m in messages if m is not None and m.n_rows]
        listed = f"{base}/batches/{batchId:012d}.json"
        if files.get_file_info(listed).type == pafs.FileType.File:
            self.abort(messages, batchId)
            return
        files.create_dir(f"{base}/batches", recursive=True)
        text = json.dumps({"batch": batchId, "n_rows": sum(m.n_rows for m in written), "files": [m.name for m in written]})
        hidden = f"{base}/batches/_{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as out:
            out.write(text.encode())
        files.move(hidden, listed)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        files, base = opened(self.path)
        for m in messages:
            if m is not None and m.n_rows:
                files.delete_file(f"{base}/data/{m.name}")


def register_sources(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(BoundedFiles)
    spark.dataSource.register(CommittedBatches)


def read_bounded(
    spark: SparkSession, path: str, records: int | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """Stream of a folder's records, at most ``records`` of them a trigger."""
    register_sources(spark)
    reader = spark.readStream.format(BoundedFiles.name())
    if schema is not None:
        reader = reader.schema(schema)
    return (reader if records is None else reader.option("recordsPerTrigger", records)).load(path)


def start_committed(rows: DataFrame, path: str, checkpoint: str, trigger: str = "0 seconds"):
    """Writes a stream's batches to ``path``."""
    register_sources(rows.sparkSession)
    writer = rows.writeStream.format(CommittedBatches.name()).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(processingTime=trigger).start(path)


def committed_batches(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, n_rows, files)`` of each visible batch."""
    return spark.read.schema(LIST_SCHEMA).json(f"{path}/batches")


def read_committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of all visible batches. The driver lists their files, as for any table."""
    listed = committed_batches(spark, path).select(F.explode("files").alias("file"))
    names = [f"{path}/data/{r.file}" for r in listed.toLocalIterator()]
    reader = spark.read.schema(schema)
    return reader.parquet(*names) if names else spark.createDataFrame([], schema)


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order; rows that tie in it are told apart by the other columns."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*").select(*rows.columns)
