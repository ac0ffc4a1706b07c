"""Current values as keyed state: each user's features in a map, with an expiry that the state itself enforces.

One operator holds what a key-value store would: a hash of features for each user and the moment it ends. A later window replaces
a feature's value, an older one that is replayed changes nothing, and a feature that a row leaves out stays as it was.
The expiry is an event-time timer: when the watermark has passed it, the user's state is cleared and the expiry is emitted. By
the clock instead, state lives for its TTL and needs no timer. State is in RocksDB with the query's checkpoint, so a
restarted query goes on with it, and a batch job reads it from there without a store in between.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from windrow.functions.time import epoch
from windrow.schema import FEATURE_TTL_SECONDS, FEATURES, TRIGGER, WATERMARK

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "user_id string, change string, window_end double, expires_at double"
CLOCK = "window_end double, computed_at double, expires_at double"
VALUE = "value double, window_end double, computed_at double"


def current_values(ttl: float, by_clock: bool) -> StatefulProcessor:
    """The operator. Its class is local so that it travels to the executors with the query."""
    names = tuple(FEATURES)
    clock_schema, value_schema = CLOCK, VALUE

    class CurrentValues(StatefulProcessor):
        def init(self, handle) -> None:
            life = int(ttl * 1000) if by_clock else None
            self.handle = handle
            self.clock = handle.getValueState("clock", clock_schema, life)
            self.values = handle.getMapState("values", "feature_name string", value_schema, life)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            last, newest = None, {}
            for row in rows:
                at = (row.window_end, row.computed_at)
                last = at if last is None or at > last else last
                for name in names:
                    if row[name] is not None and (name not in newest or at > newest[name][0]):
                        newest[name] = (at, row[name])
            held = self.clock.get() if self.clock.exists() else None
            for name, (at, value) in newest.items():
                # A user without state has no values either; otherwise the later window stays.
                old = self.values.getValue((name,)) if held is not None and self.values.containsKey((name,)) else None
                if old is None or at >= (old[1], old[2]):
                    self.values.updateValue((name,), (value, *at))
            if held is not None and last <= (held[0], held[1]):
                return
            expires = last[1] + ttl
            if not by_clock:
                if held is not None:
                    self.handle.deleteTimer(self.due(held[2]))
                self.handle.registerTimer(self.due(expires))
            self.clock.update((*last, expires))
            yield Row(user_id=key[0], change="set", window_end=last[0], expires_at=expires)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            held = self.clock.get() if self.clock.exists() else None
            if held is None or self.due(held[2]) > expiredTimerInfo.getExpiryTimeInMs():
                return
            self.clock.clear()
            self.values.clear()
            yield Row(user_id=key[0], change="expired", window_end=held[0], expires_at=held[2])

        def due(self, expires: float) -> int:
            """Timers fire below the watermark, and what ends at it has expired."""
            return int(expires * 1000) - 1

        def close(self) -> None:
            pass

    return CurrentValues()


def start_current(
    vectors: DataFrame,
    changes: str,
    checkpoint: str,
    ttl: float = FEATURE_TTL_SECONDS,
    watermark: str = WATERMARK,
    by_clock: bool = False,
    trigger: str | None = TRIGGER,
) -> StreamingQuery:
    """Keeps the current values of a stream of vectors, and appends what is set and what expires to ``changes``.

    Without ``trigger`` the query stops when the source is read through. By the clock it cannot, as state still changes
    then.
    """
    if by_clock and trigger is None:
        raise ValueError("a query by the clock has no end; give it a trigger")
    vectors.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = vectors if by_clock else vectors.withWatermark("window_end", watermark)
    rows = timed.select(
        "user_id", F.col("window_end").alias("event_time"), epoch("window_end").cast("double").alias("window_end"), "computed_at", *FEATURES
    )
    mode = "ProcessingTime" if by_clock else "EventTime"
    found = rows.groupBy("user_id").transformWithState(current_values(ttl, by_clock), CHANGES, "Append", mode)
    writer = found.writeStream.format("parquet").outputMode("append").queryName("current_values")
    writer = writer.option("path", changes).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.start()


def read_current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the state holds: a row per user that has not expired, read from the query's checkpoint."""

    def variable(name: str, column: str) -> DataFrame:
        found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
        # State that lives for its TTL has its end beside the value.
        timed = "ttlExpirationMs" in found.schema[column].dataType.fieldNames()
        return found.withColumn("held", F.col(f"{column}.value" if timed else column))

    clock = variable("clock", "value").select("key.user_id", "held.*")
    values = variable("values", "user_map_value").select("key.user_id", "user_map_key.feature_name", "held.value")
    wide = values.groupBy("user_id").agg(
        *(F.max(F.when(F.col("feature_name") == c, F.col("value"))).alias(c) for c in FEATURES)
    )
    return clock.join(wide, "user_id").select(
        "user_id", F.timestamp_seconds("window_end").alias("window_end"), "computed_at", "expires_at", *FEATURES
    )
