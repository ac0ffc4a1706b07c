"""Lookups, freshness, expiry, latency, throughput and metric reports. ``now`` is always an argument,
a double column or number of epoch seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.time import seconds
from windrow.operators.latest import sample_users
from windrow.operators.ranks import wide_quantiles
from windrow.schema import (
    FEATURE_TTL_SECONDS,
    FEATURES,
    FRESHNESS_SLA_SECONDS,
    LATENCY_SLA_MS,
    SCHEMA_VERSION,
    STALE_TTL_SECONDS,
)


def _at(now: Column | float) -> Column:
    return now if isinstance(now, Column) else F.lit(float(now))


def live(online: DataFrame, now: Column | float) -> DataFrame:
    """Rows not yet expired."""
    return online.filter(F.col("expires_at") > _at(now))


def select_features(vectors: DataFrame, requested: Sequence[str] | None = None, features: Sequence[str] = FEATURES) -> DataFrame:
    """Requested features keep their value and the others become 0.0; unknown names are ignored."""
    wanted = set(requested) if requested else set(features)
    others = [c for c in vectors.columns if c not in features]
    return vectors.select(
        *others, *[(F.col(c) if c in wanted else F.lit(0.0)).alias(c) for c in features]
    )


def serve_features(
    online: DataFrame,
    users: DataFrame,
    now: Column | float,
    requested: Sequence[str] | None = None,
    include_metadata: bool = True,
) -> DataFrame:
    """One row per requested user, with ``found`` and the live vector or zeros."""
    current = live(online, now).select("user_id", *FEATURES, "computed_at", F.lit(True).alias("found"))
    answer = users.select("user_id").join(current, "user_id", "left")
    age = F.round(_at(now) - F.col("computed_at"), 1)
    nothing = F.lit(None).cast("double")
    filled = answer.select(
        "user_id",
        F.coalesce("found", F.lit(False)).alias("found"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES],
        (F.col("computed_at") if include_metadata else nothing).alias("computed_at"),
        (age if include_metadata else nothing).alias("freshness_seconds"),
        F.lit("online_store").alias("source"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
    )
    return select_features(filled, requested)


# Freshness -----------------------------------------------------------------------------------------------


def freshness(online: DataFrame, now: Column | float) -> DataFrame:
    """Age of every user's vector in seconds."""
    return online.filter(F.col("computed_at").isNotNull()).select(
        "user_id", F.round(_at(now) - F.col("computed_at"), 1).alias("freshness_seconds")
    )


def freshness_report(ages: DataFrame, sla: float = FRESHNESS_SLA_SECONDS, approximate: bool = False) -> DataFrame:
    """One row: median and 95th percentile of the age, and users older than ``sla``."""
    late = F.col("freshness_seconds") > sla
    counts = ages.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(late).alias("violations"),
        F.round(F.avg(late.cast("double")) * 100, 1).alias("violation_pct"),
    )
    names = {"median_age": 0.5, "p95_age": 0.95}
    return _with_quantiles(counts, ages, "freshness_seconds", names, approximate).select(
        "users", *names, "violations", "violation_pct"
    )


def _with_quantiles(
    one_row: DataFrame, rows: DataFrame, value: str, names: dict[str, float], approximate: bool
) -> DataFrame:
    """Quantiles of all ``rows`` beside the one row of counts.

    The group is false for every row that is left, but made from the value, as joins on a literal would lose their key;
    the two rows meet in an aggregation.
    """
    one_group = F.col(value).isNull().alias("_group")
    values = rows.filter(F.col(value).isNotNull()).select(one_group, value)
    ranks = wide_quantiles(values, names, "_group", value, approximate).select(*names)
    both = one_row.unionByName(ranks, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def stalest(ages: DataFrame, n: int = 20) -> DataFrame:
    return ages.orderBy(F.col("freshness_seconds").desc(), "user_id").limit(n)


def sla_violations(
    online: DataFrame, registry: DataFrame, now: Column | float, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Per registered feature, users whose vector is older than the feature's own promise."""
    # Users are counted per age before an age is repeated for each feature of the vector.
    by_age = freshness(online, now).groupBy("freshness_seconds").agg(F.count(F.lit(1)).alias("users"))
    per_feature = by_age.select("*", F.explode(F.array(*[F.lit(c) for c in features])).alias("feature_name"))
    promised = registry.filter("is_active").select("feature_name", "freshness_sla_seconds")
    late = F.col("freshness_seconds") > F.col("freshness_sla_seconds")
    return (
        per_feature.join(promised, "feature_name")
        .groupBy("feature_name", "freshness_sla_seconds")
        .agg(
            F.sum("users").alias("users"),
            F.sum(F.when(late, F.col("users")).otherwise(F.lit(0))).alias("violations"),
        )
    )


# Expiry --------------------------------------------------------------------------------------------------


def find_stale(
    online: DataFrame,
    now: Column | float,
    threshold: float = STALE_TTL_SECONDS,
    sample: int | None = None,
    seed: str = "0",
) -> DataFrame:
    """Users whose vector expires in less than ``threshold`` seconds but has not yet, all or among a sample."""
    if sample is not None:
        online = online.join(sample_users(online, sample, seed), "user_id", "left_semi")
    remaining = F.floor(F.col("expires_at") - _at(now))
    return online.select("user_id", remaining.alias("ttl")).filter((F.col("ttl") > 0) & (F.col("ttl") < threshold))


def extend_ttl(online: DataFrame, users: DataFrame, now: Column | float, ttl: float = FEATURE_TTL_SECONDS) -> DataFrame:
    """``online`` with the expiry of live rows of ``users`` counted anew from ``now``; nothing is recomputed."""
    chosen = users.select("user_id").distinct().withColumn("_chosen", F.lit(True))
    renewed = F.col("_chosen") & (F.col("expires_at") > _at(now))
    return (
        online.join(chosen, "user_id", "left")
        .withColumn("expires_at", F.when(renewed, _at(now) + F.lit(float(ttl))).otherwise(F.col("expires_at")))
        .select(*online.columns)
    )


# Requests, throughput and metrics ------------------------------------------------------------------------


def latency_report(requests: DataFrame, sla_ms: float = LATENCY_SLA_MS, approximate: bool = False) -> DataFrame:
    """One row over a request log ``(status, latency_ms)``: percentiles of answered requests, errors, slow ones."""
    answered = F.col("status").isin(200, 404)
    slow = answered & (F.col("latency_ms") > sla_ms)
    counts = requests.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~answered).alias("errors"),
        F.count_if(slow).alias("above_sla"),
        F.round(F.try_divide(F.count_if(slow), F.count(F.lit(1))) * 100, 1).alias("above_sla_pct"),
    )
    names = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    return _with_quantiles(counts, requests.filter(answered), "latency_ms", names, approximate).select(
        "requests", *names, "errors", "above_sla", "above_sla_pct"
    )


def throughput(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events per second of each window, beside the estimate made from its users alone."""
    grouped = events.groupBy(F.window("timestamp", width).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("active_users")
    )
    # A tenth of an event per user and second, at most 500.
    return grouped.select(
        F.col("w.start").alias("window_start"),
        "events",
        "active_users",
        (F.col("events") / F.lit(float(seconds(width)))).alias("events_per_sec"),
        F.least(F.col("active_users") * 0.1, F.lit(500.0)).alias("estimated_events_per_sec"),
    )


# Metric types the trend reports read.
TREND_METRICS = ("psi_score", "ks_statistic", "consistency_rate")


def metric_history(
    metrics: DataFrame, now: Column, hours: int = 24, types: Sequence[str] = TREND_METRICS, limit: int | None = None
) -> DataFrame:
    """Metrics of the last hours, newest first, all or a number of them. ``now`` is a timestamp column."""
    since = now - F.expr(f"INTERVAL '{int(hours)}' HOUR")
    recent = (
        metrics.filter(F.col("metric_type").isin(*types) & (F.col("recorded_at") > since))
        .select("feature_name", "metric_type", "metric_value", "recorded_at")
        .orderBy(F.col("recorded_at").desc(), "feature_name", "metric_type")
    )
    return recent if limit is None else recent.limit(limit)


def recent_metrics(metrics: DataFrame, feature_name: str, metric_type: str, limit: int = 100) -> DataFrame:
    chosen = (F.col("feature_name") == feature_name) & (F.col("metric_type") == metric_type)
    return metrics.filter(chosen).orderBy(F.col("recorded_at").desc(), "metric_value").limit(limit)


def recent_diagnoses(diagnoses: DataFrame, limit: int = 10) -> DataFrame:
    columns = ("feature_name", "probable_cause", "cause_category", "confidence", "urgency", "computed_at")
    return diagnoses.select(*columns).orderBy(F.col("computed_at").desc(), "feature_name").limit(limit)
