"""The jobs a scheduler calls: each reads stores, runs operators and writes stores."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.time import epoch
from windrow.operators.asof import point_in_time
from windrow.operators.consistency import alerts, needs_diagnosis, validate_consistency
from windrow.operators.diagnosis import diagnose, most_severe_first
from windrow.operators.drift import DriftThresholds, detect_drift
from windrow.operators.latest import latest_per_user, sample_users
from windrow.operators.samples import two_sided, wide_to_long
from windrow.operators.serving import find_stale
from windrow.operators.vector import REFERENCE_WIDTHS, Widths, backfill_vector
from windrow.schema import ALERTS_TOPIC, FEATURES, STALE_TTL_SECONDS, TRIGGER
from windrow.sources.events import dedup_events, parse_events, read_event_stream, validate_events
from windrow.sources.stores import Baselines, FeatureHistory, Log, OnlineStore, emit, metric_log
from windrow.sources.tables import BatchTable, days_between
from windrow.streaming.features import LateRows, cell_table, compact_cells, start_history, start_online


def _held(report: DataFrame) -> DataFrame:
    """A report of one row per feature or run, computed once for its several readers."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def _metric(rows: DataFrame, metric_type: str, value: str, now: float) -> DataFrame:
    return rows.select(
        "feature_name",
        F.lit(metric_type).alias("metric_type"),
        F.col(value).alias("metric_value"),
        F.timestamp_seconds(F.lit(now)).alias("recorded_at"),
    )


def stream_features(
    spark: SparkSession,
    root: str,
    checkpoints: str,
    widths: Widths = REFERENCE_WIDTHS,
    trigger: str | None = TRIGGER,
    **source,
) -> tuple:
    """Starts both queries over one source; ``source`` is passed to ``read_event_stream``.

    Events that a producer sent twice count once. Late rows of either query go to the metric log.
    """

    def events() -> DataFrame:
        return validate_events(parse_events(read_event_stream(spark, **source)))[0]

    history, online = FeatureHistory(spark, f"{root}/history"), OnlineStore(spark, f"{root}/online")
    cells, live_cells = cell_table(spark, f"{root}/cells"), cell_table(spark, f"{root}/live_cells")
    spark.streams.addListener(LateRows(metric_log(spark, f"{root}/metrics")))
    return (
        start_history(events(), history, cells, f"{checkpoints}/history", widths, trigger),
        start_online(events(), online, live_cells, f"{checkpoints}/online", widths, trigger=trigger),
    )


def backfill(history: FeatureHistory, events: DataFrame, start, end, widths: Widths = REFERENCE_WIDTHS) -> str:
    """Recomputes the windows starting in ``[start, end]`` (UTC) and puts them in place of what is there."""
    return history.replace_range(backfill_vector(dedup_events(events), start, end, widths), start, end)


def verify_backfill(
    history: FeatureHistory, events: DataFrame, start, end, widths: Widths = REFERENCE_WIDTHS, digits: int = 6
) -> DataFrame:
    """Stored and recomputed rows per day, how many of either have no equal on the other side, and whether all agree.

    Rows are compared as a whole, by multiset difference both ways, with values rounded to ``digits``, as sums of doubles
    depend on their order. When rows were computed is not compared.
    """
    stored, expected = (
        _comparable(rows, digits)
        for rows in (
            history.read_range(start, end),
            FeatureHistory.dated(backfill_vector(dedup_events(events), start, end, widths)),
        )
    )
    sides = {
        "stored": stored,
        "expected": expected,
        "missing": expected.exceptAll(stored),
        "unexpected": stored.exceptAll(expected),
    }
    counts = [rows.groupBy("event_date").agg(F.count(F.lit(1)).alias(name)) for name, rows in sides.items()]
    found = reduce(lambda a, b: a.join(b, "event_date", "full"), counts).na.fill(0, list(sides))
    return found.withColumn("agrees", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def _comparable(vectors: DataFrame, digits: int) -> DataFrame:
    values = [F.round(c, digits).alias(c) for c in FEATURES]
    return vectors.select("event_date", "user_id", "window_start", "window_end", *values)


def differing_vectors(
    history: FeatureHistory, events: DataFrame, start, end, widths: Widths = REFERENCE_WIDTHS, digits: int = 6
) -> DataFrame:
    """The rows behind ``missing`` and ``unexpected``, each with the ``side`` it is on."""
    stored = _comparable(history.read_range(start, end), digits)
    fresh = FeatureHistory.dated(backfill_vector(dedup_events(events), start, end, widths))
    expected = _comparable(fresh, digits)
    missing = expected.exceptAll(stored).withColumn("side", F.lit("missing"))
    return missing.unionByName(stored.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def check_consistency(
    history: FeatureHistory,
    online: OnlineStore,
    metrics: Log,
    now: float,
    sample: int | None = None,
    seed: str = "0",
    **alert_sink,
) -> DataFrame:
    """Compares the latest historical with the current vector of live users and returns the report.

    The rate goes to the metric log as a share of consistent users, an alert to ``alert_sink`` (arguments of
    ``emit``) if one is named. All users are compared, or a ``sample``; the report's ``sample_size`` says how many.
    """
    served = online.read(now)
    if sample is not None:
        served = served.join(sample_users(served, sample, seed), "user_id", "left_semi")
    # A user is compared on the window being served, so a newer or older history is no difference. Only the days
    # of these windows are read.
    first, last = served.agg(F.min(epoch("window_start")), F.max(epoch("window_start"))).first()
    known = history.read()
    if first is not None:
        known = known.filter(days_between(*(datetime.fromtimestamp(t, timezone.utc) for t in (first, last))))
    stored = known.join(served.select("user_id", "window_start"), ["user_id", "window_start"], "left_semi")
    report = _held(validate_consistency(latest_per_user(stored), served))
    share = report.select(
        F.lit("all_features").alias("feature_name"), (1 - F.col("inconsistency_rate")).alias("share")
    )
    metrics.append(_metric(share, "consistency_rate", "share", now))
    if alert_sink:
        emit(alerts(report, F.lit(now)), **{"topic": ALERTS_TOPIC, **alert_sink})
    return report


def consistency_follow_up(report: DataFrame) -> DataFrame:
    """What to diagnose after ``check_consistency``; empty if nothing."""
    return needs_diagnosis(report)


def check_drift(
    online: OnlineStore,
    baselines: Baselines,
    metrics: Log,
    diagnoses: Log,
    now: float,
    sample: int | None = None,
    seed: str = "0",
    thresholds: DriftThresholds = DriftThresholds(),
) -> DataFrame:
    """Compares current values with the baselines, logs PSI and KS, diagnoses every drifting feature if any is
    critical, and returns the report. ``sample`` limits the users looked at; None takes all."""
    current = online.read(now)
    if sample is not None:
        current = current.join(sample_users(current, sample, seed), "user_id", "left_semi")
    report = _held(detect_drift(two_sided(baselines.load(now), wide_to_long(current)), thresholds))
    metrics.append(_metric(report, "psi_score", "psi_score", now))
    metrics.append(_metric(report, "ks_statistic", "ks_statistic", now))
    if not report.filter(F.col("severity") == "alert").isEmpty():
        found = diagnose(most_severe_first(report))
        diagnoses.append(found.withColumn("computed_at", F.timestamp_seconds(F.lit(now))))
    return report


def refresh_expiry(
    online: OnlineStore, now: float, threshold: float = STALE_TTL_SECONDS, sample: int | None = None, seed: str = "0"
) -> DataFrame:
    """Extends the expiry of users about to expire and returns them."""
    stale = find_stale(online.read_all(), now, threshold, sample, seed)
    online.extend(stale, now)
    return stale


def refresh_features(online: OnlineStore, users: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> str:
    """Recomputes the vectors of ``users`` with ``compute(users)``."""
    return online.refresh(users, compute)


def refresh_baselines(online: OnlineStore, baselines: Baselines, now: float) -> str:
    """Makes the current values the baseline of every feature that has any."""
    return baselines.save(wide_to_long(online.read(now)), now)


def training_set(
    history: FeatureHistory, as_of: float | None = None, cohort=None, labels: DataFrame | None = None, **asof
) -> DataFrame:
    """Vectors known at ``as_of``; with ``labels`` instead the vector current at each label's time."""
    if labels is None:
        return history.read_for_training(time.time() if as_of is None else as_of, cohort)
    return point_in_time(labels, history.read(as_of=as_of), **asof)


def maintain(
    history: FeatureHistory,
    online: OnlineStore,
    cells: Sequence[BatchTable] = (),
    now: float | None = None,
    keep_days: int | None = None,
) -> list[str]:
    """Compacts closed days of the history and of the cell tables, and the online store; returns the history's days.

    A day is closed when the next one has begun. With ``now`` expired users leave the online store; with ``keep_days``
    older days leave the history and the cells.
    """
    at = time.time() if now is None else now
    today = datetime.fromtimestamp(at, timezone.utc).date()
    compacted = history.compact(str(today))
    for table in cells:
        compact_cells(table, str(today))
    online.compact(now)
    if keep_days is not None:
        since = str(today - timedelta(days=keep_days))
        history.retain(since)
        for table in cells:
            table.drop_before(since)
    return compacted
