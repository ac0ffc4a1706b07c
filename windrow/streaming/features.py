"""Streaming features: two queries over one aggregation, both ending in the batch vector function.

The stream itself only aggregates session cells, which is a plain keyed aggregation without stream joins.
Each micro-batch appends its cells to a table, reads back what the touched users need of the lookback and
computes vectors with the code a backfill uses. Batches have names, so a repeated one replaces itself.

* The history query runs in append mode. A cell comes out once, when no more of its events can arrive, and
  all earlier cells are out by then: its vector is final.
* The online query runs in update mode and sees a cell as soon as it changes, so the current values do not
  wait for the watermark.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from windrow.functions.time import epoch
from windrow.operators.cells import CELL_KEY, fold_cells, session_cells
from windrow.operators.vector import REFERENCE_WIDTHS, Widths, vector_from_cells
from windrow.schema import FEATURE_TTL_SECONDS, TRIGGER, WATERMARK
from windrow.sources.events import dedup_events
from windrow.sources.stores import FeatureHistory, Log, OnlineStore
from windrow.sources.tables import BatchTable, days_between

_SESSION_CELL = (*CELL_KEY, "session_id")


def streamed_cells(events: DataFrame, base: str, watermark: str = WATERMARK) -> DataFrame:
    """Session cells of a stream; events later than the watermark are dropped and counted by Spark, and of events with
    one id the first counts."""
    return session_cells(dedup_events(events.withWatermark("timestamp", watermark)), base)


def cell_table(spark: SparkSession, path: str) -> BatchTable:
    """Session cells by day. In update mode a cell is written whenever it grows, and the last one counts."""
    return BatchTable(spark, path, _SESSION_CELL)


def _append_batch(table: BatchTable, batch: DataFrame, name: str) -> DataFrame | None:
    """The batch's cells as they were stored, which keeps Spark from running it again for every use; None if empty."""
    table.append(batch.withColumn("event_date", F.to_date("window_start")), name)
    return table.batch(name) if table.exists() else None


def _with_context(table: BatchTable, new: DataFrame | None, widths: Widths) -> DataFrame | None:
    """Cells of the touched users from one lookback before the batch on; None for an empty batch."""
    if new is None:
        return None
    # Seconds since 1970 mean the same in the driver whatever its time zone.
    first, last = new.agg(F.min(epoch("window_start")), F.max(epoch("window_start"))).first()
    if first is None:
        return None
    since, until = (datetime.fromtimestamp(t, timezone.utc) for t in (first - widths.lookback, last))
    context = table.read().filter(days_between(since, until) & (epoch("window_start") >= first - widths.lookback))
    return context.join(new.select("user_id").distinct(), "user_id", "left_semi")


def _name(batch: DataFrame, batch_id: int, fallback: str) -> str:
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or fallback
    return f"{query}-{batch_id}"


def _start(cells: DataFrame, mode: str, write: Callable, name: str, checkpoint: str, trigger: str | None) -> StreamingQuery:
    writer = cells.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.foreachBatch(write).start()


def start_history(
    events: DataFrame,
    history: FeatureHistory,
    cells: BatchTable,
    checkpoint: str,
    widths: Widths = REFERENCE_WIDTHS,
    trigger: str | None = TRIGGER,
    clock: Callable[[], float] = time.time,
) -> StreamingQuery:
    """Final vectors into ``history``. Without ``trigger`` the query stops when the source is read through."""

    def write(batch: DataFrame, batch_id: int) -> None:
        name = _name(batch, batch_id, checkpoint)
        new = _append_batch(cells, batch, name)
        context = _with_context(cells, new, widths)
        if context is None:
            return
        vectors = vector_from_cells(fold_cells(context), widths, F.lit(clock()))
        closed_now = new.select(*CELL_KEY).distinct()
        history.append_or_set_aside(vectors.join(closed_now, CELL_KEY, "left_semi"), name)

    return _start(streamed_cells(events, widths.base), "append", write, "feature_history", checkpoint, trigger)


def start_online(
    events: DataFrame,
    online: OnlineStore,
    live_cells: BatchTable,
    checkpoint: str,
    widths: Widths = REFERENCE_WIDTHS,
    ttl: float = FEATURE_TTL_SECONDS,
    trigger: str | None = TRIGGER,
    clock: Callable[[], float] = time.time,
) -> StreamingQuery:
    """Latest vectors of the touched users into ``online``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        name = _name(batch, batch_id, checkpoint)
        new = _append_batch(live_cells, batch, name)
        context = _with_context(live_cells, new, widths)
        if context is None:
            return
        vectors = vector_from_cells(fold_cells(context), widths, F.lit(clock()))
        online.write(vectors, ttl, name)

    return _start(streamed_cells(events, widths.base), "update", write, "feature_online", checkpoint, trigger)


def compact_cells(cells: BatchTable, closed_before: str) -> list[str]:
    """Makes one batch of each day before ``closed_before``, with the last emission of each cell; returns the days."""
    days = [d for d in cells.partitions() if d < closed_before and len(cells.batches(d)) > 1]
    cells.compact(days, ("user_id", "window_start"))
    return days


class LateRows(StreamingQueryListener):
    """Writes the rows that each batch drops as later than the watermark to the metric log, and adds them up.

    Spark tells a listener of every batch, while a query itself remembers only its last reports.
    """

    def __init__(self, metrics: Log, clock: Callable[[], float] = time.time):
        self.metrics, self.clock, self.total = metrics, clock, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators)
        if late:
            row = [(event.progress.name or str(event.progress.id), "late_rows", float(late))]
            named = self.metrics.spark.createDataFrame(row, "feature_name string, metric_type string, metric_value double")
            self.metrics.append(named.withColumn("recorded_at", F.timestamp_seconds(F.lit(float(self.clock())))))
            self.total += late
