"""Append-only Parquet tables: rows in batches, each batch in folders of its own, and the current state by query.

A table is a folder ``<partition>=<value>/batch=<name>``. Every write names its batch, so no two writers share a folder,
and a batch that is written again replaces itself and nothing else. Nothing that is stored is ever rewritten by a
write: a row is replaced by a later one of its key, and removed by a later row that says so. Which rows count is a
question to the data: the last one of each key by the time it was written, at any time of interest.

A table format with transactions can stand in its place where its connector is on the class path: ``format``
names it.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.time import bound

WRITTEN, BATCH, REMOVED = "written_at", "batch", "removed"
BOOKKEEPING = (WRITTEN, BATCH, REMOVED)


class BatchTable:
    """Rows under ``path``, by one column of few values, such as a date or a hash bucket, and by batch."""

    def __init__(
        self, spark: SparkSession, path: str, key: Sequence[str] = (), partition_by: str = "event_date", format: str = "parquet"
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.key = tuple(key)
        self.partition_by = partition_by
        self.format = format

    # Folders ------------------------------------------------------------------------------------

    def _folder(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def partitions(self) -> list[str]:
        """Values of the partition column that have a folder, in order."""
        files, path = self._folder()
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        prefix = f"{self.partition_by}="
        return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))

    def exists(self) -> bool:
        """Whether any row was ever written."""
        return bool(self.partitions())

    def batches(self, partition: str) -> list[str]:
        files, path = self._folder(f"{self.partition_by}={partition}")
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(n.removeprefix(f"{BATCH}=") for n in names if n.startswith(f"{BATCH}="))

    def drop_batches(self, partition: str, batches: Sequence[str]) -> None:
        """Deletes batches of one partition, after their rows were written elsewhere or are past keeping."""
        for batch in batches:
            files, path = self._folder(f"{self.partition_by}={partition}", f"{BATCH}={batch}")
            files.delete(path, True)
        files, path = self._folder(f"{self.partition_by}={partition}")
        if files.exists(path) and not files.listStatus(path):
            files.delete(path, False)

    # Writing ------------------------------------------------------------------------------------

    def append(self, rows: DataFrame, batch: str | None = None, written_at: float | None = None, removed: DataFrame | None = None) -> str:
        """Adds rows as one batch and returns its name. ``removed`` has the keys, with the partition column, of rows
        that no longer count."""
        name = batch_name(batch)
        now = F.lit(time.time() if written_at is None else float(written_at))
        out = rows.withColumn(WRITTEN, now).withColumn(REMOVED, F.lit(False))
        if removed is not None:
            gone = removed.withColumn(WRITTEN, now).withColumn(REMOVED, F.lit(True))
            out = out.unionByName(gone, allowMissingColumns=True)
        return self._write(out, name)

    def _write(self, rows: DataFrame, name: str) -> str:
        # Rows are gathered by partition; adaptive execution splits what is too large for a file.
        sized = rows.withColumn(BATCH, F.lit(name)).hint("rebalance", F.col(self.partition_by))
        writer = sized.write.format(self.format).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(self.partition_by, BATCH).save(self.path)
        return name

    # Reading ------------------------------------------------------------------------------------

    def rows(self, as_of: float | None = None) -> DataFrame:
        """All rows with their bookkeeping, those of each key's past included."""
        found = self.spark.read.format(self.format).option("basePath", self.path).load(self.path)
        return found if as_of is None else found.filter(F.col(WRITTEN) <= float(as_of))

    def batch(self, name: str) -> DataFrame:
        return self.rows().filter(F.col(BATCH) == batch_name(name)).drop(*BOOKKEEPING)

    def read(self, as_of: float | None = None) -> DataFrame:
        """The last row of each key by the time of writing, now or as it was at ``as_of`` (epoch seconds)."""
        return self._current(self.rows(as_of)).drop(*BOOKKEEPING)

    def _current(self, rows: DataFrame) -> DataFrame:
        if not self.key:
            return rows.filter(~F.col(REMOVED))
        # The partition column is part of the key, so that a filter on it reaches the folders.
        key = tuple(dict.fromkeys((self.partition_by, *self.key)))
        return merge_rows(None, rows, key, (WRITTEN, BATCH)).filter(~F.col(REMOVED))

    # Housekeeping -------------------------------------------------------------------------------

    def compact(
        self, partitions: Sequence[str], cluster_by: Sequence[str] = (), keep_since: float | None = None, batch: str | None = None
    ) -> None:
        """Rewrites closed partitions into one batch each, clustered, and drops the batches it was made from.

        Rows that a later one replaced are left out, or with ``keep_since`` only if that was before it, so that
        states since then can still be read. In between both forms are there, which reads the same.
        """
        name = batch_name(batch)
        for partition in map(str, partitions):
            old = [b for b in self.batches(partition) if b != name]
            if len(old) < 2:
                continue
            mine = self.rows().filter((F.col(self.partition_by) == partition) & F.col(BATCH).isin(old))
            kept = self._current(mine) if keep_since is None else self._still_read(mine, keep_since)
            clustered = kept.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else kept
            writer = clustered.drop(self.partition_by, BATCH).write.format(self.format).mode("overwrite")
            writer.save(f"{self.path}/{self.partition_by}={partition}/{BATCH}={name}")
            self.drop_batches(partition, old)

    def _still_read(self, rows: DataFrame, since: float) -> DataFrame:
        """Rows of which some state since then is made."""
        before = merge_rows(None, rows.filter(F.col(WRITTEN) <= since), self.key, (WRITTEN, BATCH))
        return before.select(*rows.columns).unionByName(rows.filter(F.col(WRITTEN) > since))

    def drop_before(self, partition: str) -> list[str]:
        """Retention: deletes all partitions below a value, and returns them."""
        old = [p for p in self.partitions() if p < partition]
        for p in old:
            files, path = self._folder(f"{self.partition_by}={p}")
            files.delete(path, True)
        return old


def batch_name(name: str | None) -> str:
    """A folder name of its own; one that begins with a letter, so that it is read as text."""
    return f"b-{uuid.uuid4().hex}" if name is None else "b-" + re.sub(r"[^A-Za-z0-9]+", "-", name.removeprefix("b-")).strip("-")


def merge_rows(existing: DataFrame | None, rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of both by ``key``, the greatest ``order`` of each. Map-side aggregation keeps one per task."""
    both = rows if existing is None else existing.unionByName(rows.select(*existing.columns))
    others = [c for c in both.columns if c not in key]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*").select(*both.columns)


# Layout of the feature history ------------------------------------------------------------------------


def with_partition_columns(vectors: DataFrame, prefix: bool = False) -> DataFrame:
    """Adds ``event_date``, the UTC day of ``computed_at``; on request also ``user_prefix``.

    The prefix is the same for all ids of the usual form and would prune nothing, so tables do without.
    """
    dated = vectors.withColumn("event_date", F.to_date(F.timestamp_seconds("computed_at")))
    return dated.withColumn("user_prefix", F.substring("user_id", 1, 3)) if prefix else dated


def partition_filter(day: date | str, prefix: str | None = None) -> Column:
    """Predicate that prunes to one day, and to a user prefix where one is given."""
    wanted = F.col("event_date") == F.lit(str(day)).cast("date")
    return wanted & (F.col("user_prefix") == prefix) if prefix else wanted


def days_between(start: datetime | str, end: datetime | str) -> Column:
    """Predicate that prunes to the days from ``start`` to ``end``."""
    return F.col("event_date").between(bound(start).cast("date"), bound(end).cast("date"))
