"""The stores: feature history, current values with expiry, baselines, metric and diagnosis logs, alerts."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.time import bound
from windrow.operators.latest import in_cohort, latest_per_user
from windrow.operators.serving import extend_ttl, live
from windrow.operators.vector import training_projection
from windrow.schema import BASELINE_TTL_SECONDS, DIAGNOSIS_SCHEMA, FEATURE_TTL_SECONDS, METRIC_SCHEMA
from windrow.sources.tables import BatchTable, days_between

_log = logging.getLogger(__name__)

VECTOR_KEY = ("user_id", "window_start")


class FeatureHistory:
    """All vectors, by the day their window starts. A user's window has one vector: the one written last.

    That holds for any mix of writers, such as a stream and a backfill beside it, as each writes batches of its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table = BatchTable(spark, path, VECTOR_KEY)
        self.spark = spark
        self.dead_letters = f"{path.rstrip('/')}_dead_letters"

    @staticmethod
    def dated(vectors: DataFrame) -> DataFrame:
        """``event_date`` comes from the window, so a vector computed twice lands on the same day."""
        return vectors.withColumn("event_date", F.to_date("window_start"))

    def append(self, vectors: DataFrame, batch: str | None = None, written_at: float | None = None) -> str:
        """Adds vectors; those of windows that are there already take their place. Repeating a batch changes nothing."""
        return self.table.append(self.dated(vectors), batch, written_at)

    def append_or_set_aside(self, vectors: DataFrame, batch: str, written_at: float | None = None) -> bool:
        """Appends, or on failure keeps the batch beside the table for ``replay``. If that fails too, so does the batch."""
        try:
            self.append(vectors, batch, written_at)
            return True
        except Exception:
            _log.exception("batch %s could not be appended and is set aside", batch)
            vectors.write.mode("overwrite").parquet(f"{self.dead_letters}/{batch.replace('/', '-')}")
            return False

    def replay(self, written_at: float | None = None) -> list[str]:
        """Appends the batches that were set aside, and returns their names; what is appended is aside no more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.dead_letters)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = []
        for folder in sorted(f.getPath().getName() for f in files.listStatus(path)):
            at = f"{self.dead_letters}/{folder}"
            self.append(self.spark.read.parquet(at), folder, written_at)
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(at), True)
            done.append(folder)
        return done

    def replace_range(self, vectors: DataFrame, start, end, batch: str | None = None, written_at: float | None = None) -> str:
        """Puts ``vectors`` in place of all windows starting in ``[start, end]``; a rerun changes nothing.

        Stored windows of the range that are not among them are marked as removed.
        """
        fresh = self.dated(vectors)
        gone = None
        if self.table.exists():
            key = ["event_date", *VECTOR_KEY]
            gone = self.read_range(start, end).select(*key).join(fresh.select(*key), key, "left_anti")
        return self.table.append(fresh, batch, written_at, removed=gone)

    def read_range(self, start, end) -> DataFrame:
        """Windows starting in ``[start, end]``; other days are not read."""
        return self.read().filter(days_between(start, end) & F.col("window_start").between(bound(start), bound(end)))

    def read(self, as_of: float | None = None) -> DataFrame:
        """Vectors as they are, or as they were at ``as_of`` (epoch seconds)."""
        return self.table.read(as_of)

    def read_for_training(self, as_of: float, cohort: DataFrame | list[str] | None = None) -> DataFrame:
        """What a model trained at ``as_of`` could have read."""
        return training_projection(in_cohort(self.read(as_of), cohort))

    def compact(self, closed_before: str, keep_since: float | None = None) -> list[str]:
        """Makes one batch of each day before ``closed_before`` that has several, and returns these days."""
        days = [d for d in self.table.partitions() if d < closed_before and len(self.table.batches(d)) > 1]
        self.table.compact(days, ("user_id", "window_start"), keep_since)
        return days

    def retain(self, since_day: str) -> list[str]:
        """Deletes the days before ``since_day``."""
        return self.table.drop_before(since_day)


class OnlineStore:
    """The latest vector of every user, with an expiry.

    Writes only append what changed; the latest row of a user is found when reading, over hash buckets that
    ``compact`` folds back to one row per user. A batch therefore costs its own size and not the store's.
    """

    # Of two rows of a user the later window wins, then the later computation, then the later expiry.
    ORDER = ("window_end", "computed_at", "expires_at")

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.buckets = buckets
        self.table = BatchTable(spark, path, partition_by="user_bucket")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("user_bucket", self.bucket())

    def write(self, vectors: DataFrame, ttl: float = FEATURE_TTL_SECONDS, batch: str | None = None) -> str:
        return self.table.append(self._bucketed(with_expiry(latest_per_user(vectors), ttl)), batch)

    def _latest(self, rows: DataFrame) -> DataFrame:
        return latest_per_user(rows, *self.ORDER, key=("user_bucket", "user_id")).drop("user_bucket")

    def read_all(self) -> DataFrame:
        """One row per user ever written, expired ones included."""
        return self._latest(self.table.read())

    def read(self, now: Column | float) -> DataFrame:
        return live(self.read_all(), now)

    def read_users(self, users: DataFrame) -> DataFrame:
        """Rows of ``users``. Their buckets are listed first, so that other buckets' folders are not read."""
        asked = users.select("user_id").distinct()
        buckets = [r[0] for r in asked.select(self.bucket()).distinct().collect()]
        rows = self.table.read().filter(F.col("user_bucket").isin(buckets))
        return self._latest(rows.join(asked, "user_id", "left_semi"))

    def active_users(self, now: Column | float | None = None) -> DataFrame:
        """Users with a live vector, or without ``now`` all ever written."""
        rows = self.read_all() if now is None else self.read(now)
        return rows.select("user_id")

    def extend(self, users: DataFrame, now: float, ttl: float = FEATURE_TTL_SECONDS) -> str:
        """Counts the expiry of live ``users`` anew. Only their rows are written."""
        chosen = self.read(now).join(users.select("user_id").distinct(), "user_id", "left_semi")
        return self.table.append(self._bucketed(extend_ttl(chosen, users, now, ttl)))

    def refresh(
        self, users: DataFrame, compute: Callable[[DataFrame], DataFrame], ttl: float = FEATURE_TTL_SECONDS
    ) -> str:
        """Recomputes the vectors of ``users`` with ``compute`` and writes them."""
        return self.write(compute(users.select("user_id").distinct()), ttl)

    def compact(self, drop_expired_before: float | None = None) -> None:
        """Leaves one row per user, expired ones out if asked for. Batches written meanwhile stay."""
        for bucket in self.table.partitions():
            old = self.table.batches(bucket)
            if len(old) < 2 and drop_expired_before is None:
                continue
            mine = self.table.rows().filter((F.col("user_bucket") == int(bucket)) & F.col("batch").isin(old))
            rows = latest_per_user(mine.drop("written_at", "batch", "removed"), *self.ORDER)
            if drop_expired_before is not None:
                rows = live(rows, drop_expired_before)
            self.table.append(rows)
            self.table.drop_batches(bucket, old)


def with_expiry(vectors: DataFrame, ttl: float = FEATURE_TTL_SECONDS) -> DataFrame:
    return vectors.withColumn("expires_at", F.col("computed_at") + F.lit(float(ttl)))


class Baselines:
    """Reference values per feature, each feature replaced on its own and kept for a week."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = BatchTable(spark, path, partition_by="feature_name")

    def save(self, samples: DataFrame, now: float, ttl: float = BASELINE_TTL_SECONDS, batch: str | None = None) -> str:
        """Replaces the baseline of every feature having values in ``(feature_name, value)``; others stay."""
        rows = samples.select("feature_name", "value", F.lit(float(now + ttl)).alias("expires_at"))
        return self.table.append(rows, batch, written_at=now)

    def load(self, now: float, features: Sequence[str] | None = None) -> DataFrame:
        """Values of the last batch of each feature, if that has not expired."""
        if not self.table.exists():
            return self.spark.createDataFrame([], "feature_name string, value double")
        rows = self.table.rows()
        if features is not None:
            rows = rows.filter(F.col("feature_name").isin(*features))
        last = rows.groupBy("feature_name").agg(F.max(F.struct("written_at", "batch")).alias("last"))
        last = last.select("feature_name", "last.batch")
        return rows.join(last, ["feature_name", "batch"]).filter(F.col("expires_at") > now).select("feature_name", "value")

    def exists(self, feature: str, now: float) -> bool:
        return not self.load(now, [feature]).isEmpty()


class Log:
    """An append-only table of a fixed schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: DataFrame) -> None:
        empty = self.spark.createDataFrame([], self.schema)
        rows.select(*[F.col(f.name).cast(f.dataType) for f in empty.schema]).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def metric_log(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, METRIC_SCHEMA)


def diagnosis_log(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, DIAGNOSIS_SCHEMA)


def emit(messages: DataFrame, *, servers: str | None = None, topic: str | None = None, folder: str | None = None) -> None:
    """Sends ``(key, value)`` rows to a topic, or appends them to a folder of JSON lines."""
    if servers is not None:
        messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    else:
        messages.write.mode("append").json(folder)
