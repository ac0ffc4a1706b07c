"""Every operator as a query over the supplied tables: ``name -> (spark, folder) -> DataFrame``.

Results are rounded to six digits, as sums of doubles depend on their order. Each windowed query comes at the
reference widths and at dense ones, where windows hold more than an event or two.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.columns import psi_reading, psi_severity
from windrow.functions.time import bound, epoch
from windrow.operators import (
    consistency,
    diagnosis,
    distribution,
    drift,
    features,
    latest,
    registry,
    rollups,
    serving,
    sketches,
)
from windrow.operators.asof import point_in_time
from windrow.operators.cells import cells, fold_cells, session_cells
from windrow.operators.samples import wide_to_long
from windrow.operators.table_function import vector_by_function
from windrow.operators.vector import (
    DENSE_WIDTHS,
    REFERENCE_WIDTHS,
    Widths,
    backfill_vector,
    feature_vector,
    training_projection,
)
from windrow.plans import jobs
from windrow.schema import FEATURES
from windrow.session import configure, scratch_folder
from windrow.sources.activity import as_events, read_activity, user_name
from windrow.sources.bucketed import BucketedTable
from windrow.sources.bounded import committed_batches, last_by_key, read_bounded, read_committed, start_committed
from windrow.sources.events import (
    dedup_events,
    encode_events,
    in_range,
    parse_events,
    parse_events_rescued,
    read_event_stream,
    sessions,
    validate_events,
)
from windrow.sources.stores import Baselines, FeatureHistory, OnlineStore, diagnosis_log, metric_log, with_expiry
from windrow.sources.tables import merge_rows, partition_filter, with_partition_columns
from windrow.streaming.current import read_current, start_current
from windrow.streaming.features import cell_table, start_history, start_online

Query = Callable[[SparkSession, str], DataFrame]

# Moments are in UTC and become literals by ``bound``, whatever the driver's time zone.
SPLIT = "2024-01-16 00:00:00"
NOW = "2024-01-29 12:00:00"
SPLIT_EPOCH = datetime(2024, 1, 16, tzinfo=timezone.utc).timestamp()
NOW_EPOCH = datetime(2024, 1, 29, 12, tzinfo=timezone.utc).timestamp()
ONLINE_TTL = 2 * 86400
# A definition that has come apart from the one history was computed with.
SKEWED_WIDTHS = Widths(base="1 day", spend="3 days", carts="1 day", views="1 day", history="3 days")


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


# Shared inputs --------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, folder: str, widths: Widths = DENSE_WIDTHS) -> DataFrame:
    return feature_vector(read_activity(spark, folder), widths)


def online_rows(spark: SparkSession, folder: str, widths: Widths = REFERENCE_WIDTHS) -> DataFrame:
    """Current values at ``NOW``, as if the stream had written them then."""
    seen = vectors(spark, folder, widths).filter(F.col("window_end") <= bound(NOW))
    return with_expiry(latest.latest_per_user(seen), ONLINE_TTL)


def drift_samples(spark: SparkSession, folder: str, widths: Widths = DENSE_WIDTHS) -> DataFrame:
    """First half of the month as baseline, second half as current.

    Values are rounded so that equal ones stay equal whatever the order their sums were made in; ranks and bins
    depend on it.
    """
    long = rounded(wide_to_long(vectors(spark, folder, widths), keep=["window_start"]), 9)
    early = F.col("window_start") < bound(SPLIT)
    return long.select("feature_name", F.when(early, "baseline").otherwise("current").alias("side"), "value")


def drift_report(spark: SparkSession, folder: str, widths: Widths = DENSE_WIDTHS) -> DataFrame:
    return drift.detect_drift(drift_samples(spark, folder, widths))


def skew_report(spark: SparkSession, folder: str, online_widths: Widths = SKEWED_WIDTHS) -> DataFrame:
    return consistency.validate_consistency(
        latest.latest_per_user(vectors(spark, folder)), latest.latest_per_user(vectors(spark, folder, online_widths))
    )


def full_records(spark: SparkSession, folder: str) -> DataFrame:
    """Event records whose place and device come from the user's customer record, where there is one."""
    segment_device = {"BUILDING": "mobile", "AUTOMOBILE": "desktop", "MACHINERY": "tablet", "HOUSEHOLD": "tv"}
    device = F.create_map(*[F.lit(x) for pair in segment_device.items() for x in pair])
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    who = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        user_name("c_custkey").alias("user_id"),
        F.struct(F.col("n_name").alias("country"), F.col("c_name").alias("city")).alias("location"),
        F.try_element_at(device, F.col("c_mktsegment")).alias("device_type"),
    )
    return (
        read_activity(spark, folder)
        .join(who, "user_id", "left")
        .withColumn("product_id", F.concat(F.lit("prod_"), "event_id"))
        .withColumn("category", F.lit("home"))
        .withColumn("schema_version", F.lit(None).cast("string"))
    )


def metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The activity table read as a metric log."""
    value = F.col("value")
    kind = F.when(value < 30, "psi_score").when(value < 60, "ks_statistic").when(value < 90, "null_rate")
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("event_type").alias("feature_name"),
        kind.otherwise("consistency_rate").alias("metric_type"),
        value.alias("metric_value"),
        F.col("ts").alias("recorded_at"),
    )


def request_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The activity table read as a request log."""
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    return spark.read.parquet(f"{folder}/events.parquet").select(status.alias("status"), F.col("value").alias("latency_ms"))


# Queries --------------------------------------------------------------------------------------------------


def _feature_queries() -> dict[str, Query]:
    def single(operator, *widths: str) -> Query:
        return lambda s, d: rounded(operator(read_activity(s, d), *widths))

    variants = {
        "txn_count": (features.txn_count, ("5 minutes",), ("1 day",)),
        "avg_spend": (features.avg_spend, ("1 hour", "5 minutes"), ("7 days", "1 day")),
        "session_activity_rate": (features.session_activity_rate, ("5 minutes",), ("1 day",)),
        "cart_abandon_ratio": (features.cart_abandon_ratio, ("30 minutes",), ("1 day",)),
        "product_interaction_freq": (features.product_interaction_freq, ("1 hour",), ("1 day",)),
        "anomaly_score": (features.anomaly_score, ("5 minutes", "24 hours"), ("1 day", "7 days")),
    }
    found = {}
    for name, (operator, reference, dense) in variants.items():
        found[name] = single(operator, *reference)
        found[f"{name}_dense"] = single(operator, *dense)
    found["feature_vector"] = lambda s, d: rounded(vectors(s, d, REFERENCE_WIDTHS))
    found["feature_vector_dense"] = lambda s, d: rounded(vectors(s, d, DENSE_WIDTHS))
    found["backfill_vector"] = lambda s, d: rounded(
        backfill_vector(
            read_activity(s, d), datetime(2024, 1, 10), datetime(2024, 1, 20), computed_at=F.lit(NOW_EPOCH)
        )
    )
    found["backfill_vector_dense"] = lambda s, d: rounded(
        backfill_vector(read_activity(s, d), datetime(2024, 1, 10), datetime(2024, 1, 20), DENSE_WIDTHS)
    )
    found["base_cells"] = lambda s, d: rounded(cells(read_activity(s, d), "1 day"))
    found["base_cells_from_sessions"] = lambda s, d: rounded(
        fold_cells(session_cells(read_activity(s, d), "1 day"))
    )
    return found


def _source_queries() -> dict[str, Query]:
    def parsed(s: SparkSession, d: str) -> DataFrame:
        # The texts are no events; each must be dropped.
        texts = s.read.parquet(f"{d}/documents.parquet").select(F.col("text").cast("binary").alias("value"))
        events = read_activity(s, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        both = encode_events(events).select("value").unionByName(texts)
        return parse_events(both).select(
            "event_id",
            "user_id",
            "session_id",
            "event_type",
            F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
            "transaction_amount",
        )

    def valid(s: SparkSession, d: str) -> DataFrame:
        kept = validate_events(full_records(s, d))[0]
        return kept.select("event_id", "user_id", "event_type", "location.country", "device_type", "schema_version")

    def rejected(s: SparkSession, d: str) -> DataFrame:
        refused = validate_events(full_records(s, d))[1]
        return refused.select("event_id", F.array_join("reject_reasons", "; ").alias("reject_reasons"))

    def history(s: SparkSession, d: str) -> DataFrame:
        events = as_events(s.read.parquet(f"{d}/events.parquet"))
        return in_range(events, datetime(2024, 1, 10), datetime(2024, 1, 20, 12))

    def merged(s: SparkSession, d: str) -> DataFrame:
        held = vectors(s, d).filter(F.col("window_start") < bound(SPLIT))
        batch = (
            vectors(s, d, SKEWED_WIDTHS)
            .filter(F.col("window_start") >= bound("2024-01-10 00:00:00"))
            .withColumn("computed_at", F.col("computed_at") + 60.0)
        )
        return rounded(merge_rows(held, batch, ("user_id", "window_start"), ("computed_at",)))

    def dated(s: SparkSession, d: str) -> DataFrame:
        with_date = with_partition_columns(vectors(s, d, REFERENCE_WIDTHS), prefix=True)
        return with_date.select("user_id", "window_start", F.col("event_date").cast("string"), "user_prefix")

    def one_day(s: SparkSession, d: str) -> DataFrame:
        with_date = with_partition_columns(vectors(s, d, REFERENCE_WIDTHS), prefix=True)
        kept = with_date.filter(partition_filter(date(2024, 1, 12), "usr"))
        return rounded(kept.select("user_id", "window_start", *FEATURES))

    def replayed(s: SparkSession, d: str) -> DataFrame:
        """The events, and a part of them sent again a minute later."""
        events = read_activity(s, d)
        again = events.filter(F.pmod(F.crc32("event_id"), F.lit(3)) == 0)
        both = events.unionByName(again.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL '1' MINUTE")))
        return dedup_events(both)

    def rescued(s: SparkSession, d: str) -> DataFrame:
        """Records of producers with other schemas: fields that are new, of another type, or missing, and broken ones."""
        number = F.col("event_id").cast("long")
        rows = full_records(s, d)
        record = F.concat(
            F.lit('{"event_id":"'), "event_id", F.lit('","user_id":"'), "user_id", F.lit('","event_type":"'), "event_type",
            F.lit('","timestamp":"'), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z"'),
            F.when(number % 5 == 0, F.lit(',"transaction_amount":"about ten"')).otherwise(F.lit(',"transaction_amount":2.5')),
            F.when(number % 3 == 0, F.lit(',"coupon":{"code":"X","off":5}')).otherwise(F.lit("")),
            F.when(number % 4 == 0, F.lit(',"location":{"country":"US","city":"A","zip":12}'))
            .when(number % 4 == 1, F.lit(',"location":"US"')).otherwise(F.lit("")),
            F.when(number % 11 == 0, F.lit(',"category":null}')).when(number % 13 == 0, F.lit(',"category":')).otherwise(F.lit("}")),
        )
        found = parse_events_rescued(rows.select(record.alias("value")))
        entries = F.array_sort(F.transform(F.map_entries("rescued"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
        return found.select(
            "event_id",
            "user_id",
            "transaction_amount",
            F.col("location.city").alias("city"),
            F.unix_micros("timestamp").cast("string").alias("micros"),
            F.array_join(F.when(F.map_contains_key("rescued", "$"), F.array(F.lit("$"))).otherwise(entries), ";").alias("rescued"),
        )

    return {
        "dedup_events": replayed,
        "sessions": lambda s, d: sessions(read_activity(s, d)),
        "sessions_daily": lambda s, d: sessions(read_activity(s, d), "1 day"),
        "parse_events": parsed,
        "rescued_events": rescued,
        "validate_events": valid,
        "rejected_events": rejected,
        "event_history": history,
        "partition_columns": dated,
        "partition_filter": one_day,
        "upsert_vectors": merged,
    }


def _store_queries() -> dict[str, Query]:
    def versions(s: SparkSession, d: str) -> FeatureHistory:
        store = FeatureHistory(s, f"{scratch_folder(s)}/history")
        everything = vectors(s, d)
        store.append(everything.filter(F.col("window_start") < bound(SPLIT)), written_at=100.0)
        later = vectors(s, d, SKEWED_WIDTHS).withColumn("computed_at", F.col("computed_at") + 60.0)
        store.append(later.filter(F.col("window_start") >= bound("2024-01-10 00:00:00")), written_at=200.0)
        return store

    def compacted(s: SparkSession, d: str) -> DataFrame:
        store = versions(s, d)
        store.compact("2024-01-20")
        return with_text_date(store.read())

    def with_text_date(frame: DataFrame) -> DataFrame:
        return rounded(frame.withColumn("event_date", F.col("event_date").cast("string")))

    def in_use(s: SparkSession, d: str) -> DataFrame:
        store = OnlineStore(s, f"{scratch_folder(s)}/online", buckets=8)
        everything = vectors(s, d, REFERENCE_WIDTHS)
        # The later half is written first; the earlier one, replayed after it, must not undo it.
        late = F.col("window_start") >= bound(SPLIT)
        store.write(everything.filter(late), ONLINE_TTL)
        store.write(everything.filter(~late), ONLINE_TTL)
        store.compact()
        return rounded(store.read_all())

    def closed(s: SparkSession, d: str, root: str) -> FeatureHistory:
        history = FeatureHistory(s, f"{root}/history")
        query = start_history(
            activity_stream(s, d, root), history, cell_table(s, f"{root}/cells"), f"{root}/checkpoint", trigger=None,
            clock=lambda: NOW_EPOCH,
        )
        query.awaitTermination()
        return history

    def closed_stream(s: SparkSession, d: str) -> DataFrame:
        return rounded(_without_zone(closed(s, d, scratch_folder(s)).read().drop("event_date")))

    def backfilled(s: SparkSession, d: str) -> DataFrame:
        """A backfill beside a stream that overlaps it: one vector of each window, that of the backfill inside its range."""
        history = closed(s, d, scratch_folder(s))
        events = dedup_events(read_activity(s, d)).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        fresh = backfill_vector(events, *BACKFILLED, computed_at=F.lit(1.0))
        history.replace_range(fresh, *BACKFILLED)
        return rounded(_without_zone(history.read().drop("event_date")))

    def online_stream(s: SparkSession, d: str) -> DataFrame:
        root = scratch_folder(s)
        online = OnlineStore(s, f"{root}/online", buckets=8)
        query = start_online(
            activity_stream(s, d, root), online, cell_table(s, f"{root}/live"), f"{root}/checkpoint", trigger=None,
            clock=lambda: NOW_EPOCH,
        )
        query.awaitTermination()
        return rounded(_without_zone(online.read(NOW_EPOCH + 1)))

    def admitted(s: SparkSession, d: str) -> DataFrame:
        """How many events each trigger took of a stream that may take a sixth of them at once."""
        return committed_batches(s, committed_activity(s, d)).select("batch", "n_rows")

    def keyed(s: SparkSession, d: str) -> DataFrame:
        """The last event of each user, as written by a stream batch by batch."""
        rows = read_committed(s, committed_activity(s, d), ACTIVITY_COLUMNS)
        last = last_by_key(rows, ["user_id"], ["timestamp", "event_id"])
        return last.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))

    def served(s: SparkSession, d: str) -> DataFrame:
        """All customers asked of a store, of whom some have used nothing so far."""
        store = OnlineStore(s, f"{scratch_folder(s)}/online", buckets=8)
        store.write(vectors(s, d, REFERENCE_WIDTHS).filter(F.col("window_end") <= bound(NOW)), ONLINE_TTL)
        users = s.read.parquet(f"{d}/customer.parquet").select(user_name("c_custkey").alias("user_id"))
        return rounded(serving.serve_features(store.read_users(users), users, NOW_EPOCH))

    def checked(s: SparkSession, d: str) -> DataFrame:
        """The consistency job over stores, whose history holds later windows than those served."""
        root = scratch_folder(s)
        history, online = FeatureHistory(s, f"{root}/history"), OnlineStore(s, f"{root}/online", buckets=8)
        history.append(vectors(s, d))
        online.write(vectors(s, d, SKEWED_WIDTHS).filter(F.col("window_end") <= bound(NOW)), ONLINE_TTL)
        return rounded(jobs.check_consistency(history, online, metric_log(s, f"{root}/metrics"), NOW_EPOCH))

    def logged(s: SparkSession, d: str) -> DataFrame:
        """What the consistency job and the drift job write to the metric log."""
        root = scratch_folder(s)
        online, baselines = OnlineStore(s, f"{root}/online", buckets=8), Baselines(s, f"{root}/baselines")
        metrics, diagnoses = metric_log(s, f"{root}/metrics"), diagnosis_log(s, f"{root}/diagnoses")
        users = latest.latest_per_user(vectors(s, d))
        early = latest.latest_per_user(vectors(s, d).filter(F.col("window_start") < bound(SPLIT)))
        baselines.save(rounded(wide_to_long(early), 9), NOW_EPOCH)
        online.write(_rounded_features(users), ONLINE_TTL * 30)
        jobs.check_drift(online, baselines, metrics, diagnoses, NOW_EPOCH)
        return metrics.read().select("feature_name", "metric_type", "metric_value", F.unix_seconds("recorded_at").alias("recorded_at"))

    def diagnosed(s: SparkSession, d: str) -> DataFrame:
        root = scratch_folder(s)
        log = diagnosis_log(s, f"{root}/diagnoses")
        found = diagnosis.diagnose(drift_report(s, d, REFERENCE_WIDTHS))
        log.append(found.withColumn("computed_at", F.timestamp_seconds(F.lit(NOW_EPOCH))))
        shown = serving.recent_diagnoses(log.read())
        return shown.withColumn("computed_at", F.unix_seconds("computed_at"))

    def verified(s: SparkSession, d: str) -> DataFrame:
        history = FeatureHistory(s, f"{scratch_folder(s)}/history")
        events = read_activity(s, d)
        jobs.backfill(history, events, "2024-01-10 00:00:00", "2024-01-15 12:00:00")
        found = jobs.verify_backfill(history, events, "2024-01-10 00:00:00", "2024-01-17 00:00:00")
        return found.withColumn("event_date", F.col("event_date").cast("string"))

    def refreshed(s: SparkSession, d: str, compute: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Users whose vectors expire within a day of the split have them recomputed over the whole month."""
        store = OnlineStore(s, f"{scratch_folder(s)}/online", buckets=8)
        everything = vectors(s, d, REFERENCE_WIDTHS)
        store.write(everything.filter(F.col("window_start") < bound(SPLIT)), ONLINE_TTL)
        chosen = serving.find_stale(store.read_all(), SPLIT_EPOCH, 86400)
        jobs.refresh_features(store, chosen, compute or (lambda users: everything.join(users, "user_id", "left_semi")))
        return rounded(store.read_all())

    def by_function(s: SparkSession, d: str) -> DataFrame:
        """The same, recomputed by the table function over the cells of these users."""

        def compute(users: DataFrame) -> DataFrame:
            return vector_by_function(cells(read_activity(s, d).join(users, "user_id", "left_semi")))

        return refreshed(s, d, compute)

    def current(s: SparkSession, d: str) -> DataFrame:
        """Vectors replayed by time into keyed state that expires by itself; the query is stopped and goes on half-way."""
        root = scratch_folder(s)
        every = vectors(s, d, REFERENCE_WIDTHS)
        stamps = {c: F.col(c).cast("timestamp") for c in ("window_start", "window_end")}
        every.withColumns(stamps).write.parquet(f"{root}/vectors")
        stored = s.read.parquet(f"{root}/vectors")
        for since, until in zip(HALVES, HALVES[1:]):
            part = stored.filter((F.col("window_end") >= bound(since)) & (F.col("window_end") < bound(until)))
            part.write.mode("append").parquet(f"{root}/arriving")
            arriving = s.readStream.schema(stored.schema).parquet(f"{root}/arriving")
            start_current(arriving, f"{root}/changes", f"{root}/checkpoint", ONLINE_TTL, trigger=None).awaitTermination()
        return rounded(_without_zone(read_current(s, f"{root}/checkpoint")))

    return {
        "streamed_current": current,
        "admitted_batches": admitted,
        "keyed_activity": keyed,
        "history_at_version": lambda s, d: with_text_date(versions(s, d).read(as_of=100.0)),
        "history_as_of": lambda s, d: with_text_date(versions(s, d).read_for_training(as_of=250.0)),
        "history_compacted": compacted,
        "history_after_backfill_and_stream": backfilled,
        "online_after_batches": in_use,
        "streamed_history": closed_stream,
        "streamed_online": online_stream,
        "serve_from_store": served,
        "check_consistency": checked,
        "logged_metrics": logged,
        "recent_diagnoses": diagnosed,
        "verify_backfill": verified,
        "refresh_features": refreshed,
        "refresh_by_function": by_function,
    }


HALVES = ("2000-01-01 00:00:00", SPLIT, "2100-01-01 00:00:00")
# A range that the backfill beside a stream replaces.
BACKFILLED = ("2024-01-12 00:00:00", "2024-01-20 12:00:00")
STREAM_PARTS = 4


def _rounded_features(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.round(c, 9) for c in FEATURES})


def activity_stream(s: SparkSession, d: str, root: str) -> DataFrame:
    """The activity table as JSON lines in parts by time, replayed a part at a time through the event reader.

    A part of the events is sent twice.
    """
    events = read_activity(s, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    low, high = events.agg(F.min(epoch("timestamp")), F.max(epoch("timestamp"))).first()
    part = F.floor((epoch("timestamp") - low) * STREAM_PARTS / (high + 1 - low)).cast("int")
    parts = events.withColumn("part", part)
    lines = parts.unionByName(parts.filter(F.pmod(F.crc32("event_id"), F.lit(10)) == 0))
    record = F.to_json(F.struct(*events.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    # Every part is written by several tasks, and all of its files are one batch, as events of a part are in no order.
    files = max(2, s.sparkContext.defaultParallelism)
    for number in range(STREAM_PARTS):
        chosen = lines.filter(F.col("part") == number).select(record.alias("value"))
        chosen.repartition(files).write.mode("append").text(f"{root}/events")
    return parse_events(read_event_stream(s, folder=f"{root}/events", max_files=files))


ACTIVITY_COLUMNS = "event_id string, user_id string, timestamp timestamp, event_type string"


def committed_activity(s: SparkSession, d: str) -> str:
    """Folder of batches of the activity table, streamed from Parquet files a sixth at a time."""
    root = scratch_folder(s)
    events = read_activity(s, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    events.select("event_id", "user_id", "timestamp", "event_type").write.parquet(f"{root}/events")
    sixth = s.read.parquet(f"{root}/events").count() // 6 + 1
    stream = read_bounded(s, f"{root}/events", sixth, ACTIVITY_COLUMNS)
    query = start_committed(stream, f"{root}/committed", f"{root}/checkpoint")
    query.processAllAvailable()
    query.stop()
    return f"{root}/committed"


def bucketed(s: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """The rows written in buckets by user and read back."""
    root = scratch_folder(s)
    table = BucketedTable(s, f"{name}_{root.rsplit('-', 1)[1]}", f"{root}/{name}", buckets=8)
    table.write(rows)
    return table.read()


def _without_zone(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else c for c, t in frame.dtypes])


def _user_queries() -> dict[str, Query]:
    def cohort(s: SparkSession, d: str) -> DataFrame:
        customer = s.read.parquet(f"{d}/customer.parquet").filter(F.col("c_mktsegment") == "BUILDING")
        users = customer.select(user_name("c_custkey").alias("user_id"))
        dated = FeatureHistory.dated(latest.in_cohort(vectors(s, d), users))
        return rounded(training_projection(dated).withColumn("event_date", F.col("event_date").cast("string")))

    def labels(s: SparkSession, d: str) -> DataFrame:
        searches = read_activity(s, d).filter(F.col("event_type") == "search")
        return searches.select("event_id", "user_id", F.col("timestamp").alias("label_ts"))

    def training(max_age: str | None, widths: Widths) -> Query:
        return lambda s, d: rounded(
            point_in_time(labels(s, d), vectors(s, d, widths), grid=widths.base, max_age=max_age)
        )

    return {
        "latest_vector": lambda s, d: rounded(latest.latest_per_user(vectors(s, d, REFERENCE_WIDTHS))),
        "latest_vector_dense": lambda s, d: rounded(latest.latest_per_user(vectors(s, d))),
        "sample_users": lambda s, d: latest.sample_users(read_activity(s, d), 50, "7"),
        "active_users": lambda s, d: latest.active_user_count(read_activity(s, d)),
        "cohort_training_rows": cohort,
        "point_in_time": training(None, REFERENCE_WIDTHS),
        "point_in_time_max_age": training("2 days", REFERENCE_WIDTHS),
        "point_in_time_dense": training(None, DENSE_WIDTHS),
    }


def _distribution_queries() -> dict[str, Query]:
    def severity(s: SparkSession, d: str) -> DataFrame:
        scored = distribution.psi(drift_samples(s, d))
        score = F.col("psi_score")
        return scored.select(
            "feature_name", psi_severity(score).alias("severity"), psi_reading(score).alias("psi_interpretation")
        )

    def long(s: SparkSession, d: str) -> DataFrame:
        return rounded(wide_to_long(vectors(s, d, REFERENCE_WIDTHS), keep=["user_id", "window_start"]))

    def self_compared(s: SparkSession, d: str) -> DataFrame:
        # A baseline is kept for three features only; the others stand in for themselves.
        samples = drift_samples(s, d)
        kept = samples.filter((F.col("side") == "current") | F.col("feature_name").isin(*FEATURES[:3]))
        return rounded(drift.detect_drift(kept))

    def exact(s: SparkSession, d: str) -> DataFrame:
        found = distribution.ks_2samp(drift_samples(s, d), method="exact")
        return found.select("feature_name", "ks_statistic", "ks_p_value")

    def dated_values(s: SparkSession, d: str) -> DataFrame:
        return rounded(wide_to_long(vectors(s, d), keep=["window_start"]), 9)

    def sketched(s: SparkSession, d: str) -> DataFrame:
        """The month merged from stored sketches of its days, and whether each percentile's rank is within one percent."""
        values = dated_values(s, d)
        path = f"{scratch_folder(s)}/daily_values"
        sketches.daily_values(values, F.to_date("window_start")).write.parquet(path)
        merged = sketches.summary(s.read.parquet(path))
        shares = sketches.rank_shares(values, merged)
        within = [
            ((F.col(f"{n}_below") <= q + 0.01) & (F.col(f"{n}_upto") >= q - 0.01)).alias(f"{n}_within")
            for q, n in ((q, sketches.quantile_name(q)) for q in sketches.QUANTILES)
        ]
        return rounded(merged.join(F.broadcast(shares), "feature_name").select("feature_name", "n", "mean", "min", "max", *within))

    def weekly_users(s: SparkSession, d: str) -> DataFrame:
        path = f"{scratch_folder(s)}/daily_users"
        sketches.daily_users(read_activity(s, d), F.to_date("timestamp")).write.parquet(path)
        found = sketches.active_users(s.read.parquet(path), 7)
        return found.withColumn("day", F.col("day").cast("string"))

    return {
        "psi": lambda s, d: distribution.psi(drift_samples(s, d, REFERENCE_WIDTHS)),
        "psi_dense": lambda s, d: distribution.psi(drift_samples(s, d)),
        "psi_severity": severity,
        "ks_2samp": lambda s, d: distribution.ks_2samp(drift_samples(s, d)),
        "ks_2samp_exact": exact,
        "sketched_summary": sketched,
        "weekly_users": weekly_users,
        "drift_levels": lambda s, d: rollups.drift_levels(drift_samples(s, d)),
        "z_score": lambda s, d: distribution.z_score(drift_samples(s, d)),
        "kl_divergence": lambda s, d: rounded(distribution.kl_divergence(drift_samples(s, d))),
        "detect_drift": lambda s, d: rounded(drift_report(s, d)),
        "detect_drift_missing_baseline": self_compared,
        "drift_verdict": lambda s, d: drift.drift_verdict(drift_report(s, d)),
        "wide_to_long": long,
        "histogram": lambda s, d: rounded(distribution.histogram(drift_samples(s, d).drop("side"), 30)),
        "histogram_two_sided": lambda s, d: rounded(distribution.histogram(drift_samples(s, d), 20)),
        "feature_summary": lambda s, d: distribution.feature_summary(wide_to_long(vectors(s, d))),
        "box_stats": lambda s, d: rounded(distribution.box_stats(wide_to_long(vectors(s, d)))),
    }


def _consistency_queries() -> dict[str, Query]:
    def per_user(s: SparkSession, d: str) -> DataFrame:
        online = online_rows(s, d, SKEWED_WIDTHS)
        return rounded(consistency.deviations(latest.latest_per_user(vectors(s, d)), online))

    def bucketed_per_user(s: SparkSession, d: str) -> DataFrame:
        """Two stores of a row per user that meet bucket by bucket."""
        offline = bucketed(s, "offline", latest.latest_per_user(vectors(s, d)))
        return rounded(consistency.deviations(offline, bucketed(s, "online", online_rows(s, d, SKEWED_WIDTHS))))

    def alert(s: SparkSession, d: str) -> DataFrame:
        sent = consistency.alerts(skew_report(s, d), F.lit(NOW_EPOCH))
        value = """
            alert_type string, severity string, inconsistency_rate double, worst_feature string,
            max_deviation double, sample_size long, timestamp double
        """
        return rounded(sent.select("key", F.from_json("value", value).alias("v")).select("key", "v.*"))

    return {
        "relative_deviation": per_user,
        "bucketed_deviation": bucketed_per_user,
        "consistency": lambda s, d: rounded(skew_report(s, d)),
        "consistency_healthy": lambda s, d: rounded(skew_report(s, d, DENSE_WIDTHS)),
        "skew_severity": lambda s, d: consistency.classify_skew(skew_report(s, d)).select("inconsistency_rate", "severity"),
        "skew_alert": alert,
        "consistency_follow_up": lambda s, d: rounded(consistency.needs_diagnosis(skew_report(s, d))),
    }


def _serving_queries() -> dict[str, Query]:
    def users(s: SparkSession, d: str) -> DataFrame:
        customer = s.read.parquet(f"{d}/customer.parquet")
        return customer.select(user_name("c_custkey").alias("user_id"))

    def bucketed_lookup(s: SparkSession, d: str) -> DataFrame:
        """All customers looked up in a table of current values, both in buckets by user."""
        asked, current = bucketed(s, "asked", users(s, d)), bucketed(s, "current", online_rows(s, d))
        return rounded(serving.serve_features(current, asked, NOW_EPOCH))

    def ages(s: SparkSession, d: str) -> DataFrame:
        return serving.freshness(online_rows(s, d), NOW_EPOCH)

    def stale(s: SparkSession, d: str, sample: int | None = None) -> DataFrame:
        return serving.find_stale(online_rows(s, d), NOW_EPOCH, 86400, sample, "7")

    def violations(s: SparkSession, d: str) -> DataFrame:
        return serving.sla_violations(online_rows(s, d), registry.seed_definitions(s), NOW_EPOCH)

    def extended(s: SparkSession, d: str) -> DataFrame:
        rows = serving.extend_ttl(online_rows(s, d), stale(s, d), NOW_EPOCH, ONLINE_TTL)
        return rows.select("user_id", "computed_at", "expires_at")

    def by_levels(s: SparkSession, d: str) -> DataFrame:
        segments = s.read.parquet(f"{d}/customer.parquet").select(user_name("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
        return rollups.activity_levels(read_activity(s, d), segments).withColumn("day", F.col("day").cast("string"))

    return {
        "serve_features": lambda s, d: rounded(serving.serve_features(online_rows(s, d), users(s, d), NOW_EPOCH)),
        "bucketed_lookup": bucketed_lookup,
        "serve_requested_features": lambda s, d: rounded(
            serving.serve_features(
                online_rows(s, d), users(s, d), NOW_EPOCH, ["avg_spend_1h", "anomaly_score", "unknown"], False
            )
        ),
        "live_rows": lambda s, d: rounded(serving.live(online_rows(s, d), NOW_EPOCH)),
        "freshness": ages,
        "freshness_report": lambda s, d: rounded(serving.freshness_report(ages(s, d), 86400)),
        "stalest_users": lambda s, d: serving.stalest(ages(s, d), 20),
        "sla_violations": violations,
        "stale_users": stale,
        "stale_users_sampled": lambda s, d: stale(s, d, 60),
        "extend_ttl": extended,
        "latency_report": lambda s, d: rounded(serving.latency_report(request_rows(s, d))),
        "activity_levels": by_levels,
        "throughput": lambda s, d: rounded(serving.throughput(read_activity(s, d))),
        "throughput_daily": lambda s, d: rounded(serving.throughput(read_activity(s, d), "1 day")),
        "metric_history": lambda s, d: serving.metric_history(metric_rows(s, d), bound(NOW)),
        "recent_metrics": lambda s, d: serving.recent_metrics(metric_rows(s, d), "view", "psi_score"),
    }


def _diagnosis_queries() -> dict[str, Query]:
    def found(s: SparkSession, d: str) -> DataFrame:
        return _flat_arrays(diagnosis.diagnose(drift_report(s, d, REFERENCE_WIDTHS)))

    def per_user(s: SparkSession, d: str) -> DataFrame:
        # Every user's month against all users': one drift row per user and half a dozen causes.
        moments = vectors(s, d).groupBy("user_id").agg(
            F.avg("anomaly_score").alias("a"), F.avg("cart_abandon_ratio").alias("c"), F.max("anomaly_score").alias("z")
        )
        rows = moments.select(
            F.col("user_id").alias("feature_name"),
            F.round(F.col("a") / 4, 6).alias("psi_score"),
            F.round(F.col("c") / 4, 6).alias("ks_p_value"),
            F.round(-2 * F.col("z"), 6).alias("z_score"),
        )
        return _flat_arrays(diagnosis.diagnose(rows))

    def context(s: SparkSession, d: str) -> DataFrame:
        report = drift_report(s, d).select(
            "feature_name", "psi_score", "ks_statistic", "ks_p_value", "z_score", "kl_divergence", "severity",
            F.lit("first_half").alias("baseline_period"), F.lit("second_half").alias("current_period"),
            F.col("current_size").alias("sample_size"), F.lit(NOW_EPOCH).alias("computed_at"),
        )
        made = diagnosis.diagnosis_context(report, registry.seed_definitions(s))

        def at(path: str):
            return F.get_json_object("context", f"$.{path}")

        return made.select(
            "feature_name",
            F.round(at("drift_metrics.psi_score").cast("double"), 6).alias("psi_score"),
            at("drift_metrics.psi_interpretation").alias("psi_interpretation"),
            at("drift_metrics.ks_significant").alias("ks_significant"),
            at("drift_metrics.z_score_anomalous").alias("z_score_anomalous"),
            at("severity").alias("severity"),
            at("time_context.sample_size").cast("long").alias("sample_size"),
            at("time_context.analysis_timestamp").alias("analysis_timestamp"),
            at("feature_metadata.owner").alias("owner"),
        )

    def described(s: SparkSession, d: str) -> DataFrame:
        definitions = registry.seed_definitions(s)
        return registry.describe(
            drift_report(s, d).select("feature_name", "severity"), definitions, "window_type", "freshness_sla_seconds", "owner"
        )

    def lineage(s: SparkSession, d: str) -> DataFrame:
        counted = wide_to_long(vectors(s, d)).groupBy("feature_name").agg(F.count_if(F.col("value") > 0).alias("n_positive"))
        listed = registry.list_features(registry.seed_definitions(s), registry.seed_lineage(s))
        return counted.join(listed.select("feature_name", F.inline("lineage")), "feature_name")

    def one_feature(s: SparkSession, d: str) -> DataFrame:
        counted = wide_to_long(vectors(s, d)).groupBy("feature_name").agg(F.count(F.lit(1)).alias("n_values"))
        found = registry.get_feature(registry.seed_definitions(s), registry.seed_lineage(s), "anomaly_score")
        return counted.join(found.select("feature_name", "owner", F.size("lineage").alias("n_steps")), "feature_name")

    def unregistered(s: SparkSession, d: str) -> DataFrame:
        seen = wide_to_long(vectors(s, d)).filter(F.col("value") > 3).select("feature_name").distinct()
        return registry.missing_seeds(seen, registry.seed_definitions(s)).select("feature_name", "owner")

    def ranked(s: SparkSession, d: str) -> DataFrame:
        return diagnosis.most_severe_first(drift_report(s, d)).select("feature_name", "psi_score", "severity")

    return {
        "diagnose_features": found,
        "diagnose_users": per_user,
        "diagnosis_context": context,
        "most_severe_first": ranked,
        "describe_features": described,
        "feature_lineage": lineage,
        "get_feature": one_feature,
        "missing_seeds": unregistered,
    }


def _flat_arrays(frame: DataFrame) -> DataFrame:
    return frame.select(
        *[F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in frame.dtypes]
    )


def all_queries() -> dict[str, Query]:
    groups = (
        _feature_queries(),
        _source_queries(),
        _store_queries(),
        _user_queries(),
        _distribution_queries(),
        _consistency_queries(),
        _serving_queries(),
        _diagnosis_queries(),
    )

    def configured(query: Query) -> Query:
        return lambda spark, folder: query(configure(spark), folder)

    return {name: configured(query) for group in groups for name, query in group.items()}
