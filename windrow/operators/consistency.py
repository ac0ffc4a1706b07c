"""History against current values: how far what was trained on is from what is served."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.columns import relative_deviation, skew_severity
from windrow.schema import ALERT_KEY, FEATURES

THRESHOLD = 0.01
# Fixed value: share of inconsistent users above which a diagnosis is asked for.
DIAGNOSE_ABOVE = 0.05


def deviations(offline: DataFrame, online: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row per offline user: the relative deviation of every feature.

    Users or features missing online count as 0.0, users only online are ignored. Both sides have one row
    per user, so the join has no hot key.
    """
    left = offline.select("user_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in features])
    right = online.select("user_id", *[F.col(c).alias(f"_{c}") for c in features])
    return left.join(right, "user_id", "left").select(
        "user_id",
        *[relative_deviation(F.col(c), F.coalesce(F.col(f"_{c}"), F.lit(0.0))).alias(c) for c in features],
    )


def is_inconsistent(threshold: float = THRESHOLD, features: Sequence[str] = FEATURES) -> Column:
    return F.greatest(*[F.col(c) for c in features]) > threshold


def validate_consistency(
    offline: DataFrame, online: DataFrame, threshold: float = THRESHOLD, features: Sequence[str] = FEATURES
) -> DataFrame:
    """One row: sizes, rate, mean deviation ``dev_<feature>`` per feature, the worst one, and health."""
    compared = deviations(offline, online, features)
    sums = compared.agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.count_if(is_inconsistent(threshold, features)).alias("inconsistent_users"),
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"dev_{c}") for c in features],
    )
    # Greatest deviation first, the earlier feature on ties.
    ranked = F.array_max(
        F.array(
            *[
                F.struct(F.col(f"dev_{c}").alias("dev"), F.lit(-i).alias("order"), F.lit(c).alias("name"))
                for i, c in enumerate(features)
            ]
        )
    )
    rate = F.round(F.col("inconsistent_users") / F.greatest(F.col("sample_size"), F.lit(1)), 6)
    return (
        sums.withColumn("_worst", ranked)
        .withColumn("inconsistency_rate", rate)
        .select(
            "sample_size",
            (F.col("sample_size") - F.col("inconsistent_users")).alias("consistent_users"),
            "inconsistent_users",
            "inconsistency_rate",
            *[f"dev_{c}" for c in features],
            F.col("_worst.name").alias("worst_feature"),
            F.col("_worst.dev").alias("max_deviation"),
            (F.col("inconsistency_rate") <= threshold).alias("is_healthy"),
        )
    )


def classify_skew(report: DataFrame) -> DataFrame:
    return report.withColumn("severity", skew_severity(F.col("inconsistency_rate")))


def alerts(report: DataFrame, at: Column) -> DataFrame:
    """``(key, value)`` rows for the alert topic; none where nothing is inconsistent. ``at`` is epoch seconds."""
    classified = classify_skew(report).filter(F.col("severity") != "none")
    return classified.select(
        F.lit(ALERT_KEY).alias("key"),
        F.to_json(
            F.struct(
                F.lit("training_serving_skew").alias("alert_type"),
                "severity",
                "inconsistency_rate",
                "worst_feature",
                "max_deviation",
                "sample_size",
                at.cast("double").alias("timestamp"),
            )
        ).alias("value"),
    )


def needs_diagnosis(report: DataFrame) -> DataFrame:
    """The worst feature of runs above the limit; empty where all is well."""
    return report.filter(F.col("inconsistency_rate") > DIAGNOSE_ABOVE).select(
        F.col("worst_feature").alias("feature_name"), "inconsistency_rate", "max_deviation"
    )
