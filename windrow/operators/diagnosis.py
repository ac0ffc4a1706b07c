"""Rule-based diagnosis of drifting features, over all of them at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.columns import psi_reading


@dataclass(frozen=True)
class _Finding:
    category: str
    urgency: str
    confidence: float
    cause: str
    cause_values: tuple[str, ...]
    steps: tuple[str, ...]


# The findings' texts, confidences and steps. %s and %.nf take the values named beside the text;
# {entity} is the first ten letters of the feature's name.
_DELAY = _Finding(
    "data_pipeline_delay",
    "high",
    0.72,
    "Major distribution shift in %s (PSI=%.3f, Z=%.2f). "
    "Likely cause: Kafka consumer lag causing stale cached values or upstream data volume spike.",
    ("feature_name", "psi_score", "abs_z"),
    (
        "1. Check Kafka consumer lag for topic ecommerce.events.raw (group: feature-processor-cg)",
        "2. Verify Redis TTL for features:{entity}:* keys",
        "3. Check Spark streaming micro-batch processing time in Spark UI",
        "4. Review ingestion service logs for errors in the last hour",
    ),
)
_QUALITY = _Finding(
    "upstream_data_quality",
    "medium",
    0.55,
    "Moderate distribution shift in %s (PSI=%.3f). "
    "Possible upstream data quality issue or legitimate seasonal pattern.",
    ("feature_name", "psi_score"),
    (
        "1. Review event schema changes in ingestion service",
        "2. Check null/invalid transaction_amount rates in raw events",
        "3. Compare event volume to same time last week",
        "4. Verify no recent schema migrations on upstream services",
    ),
)
_SEASON = _Finding(
    "seasonal_pattern",
    "low",
    0.45,
    "Statistically significant distribution change in %s (KS p-value=%.4f). Could be legitimate seasonal variation.",
    ("feature_name", "ks_p_value"),
    (
        "1. Compare current distribution to same hour/day last week",
        "2. Check for marketing campaigns or external events",
        "3. Update baseline distribution if change is expected",
    ),
)
_UNKNOWN = _Finding(
    "unknown",
    "low",
    0.30,
    "Minor drift detected in %s. Insufficient signal for confident diagnosis.",
    ("feature_name",),
    ("1. Continue monitoring", "2. Collect more data before taking action"),
)
_IMPACT = "Potential model accuracy degradation for features depending on %s."
_MODEL = "rule_based_fallback"


def _as_struct(finding: _Finding) -> Column:
    entity = F.substring("feature_name", 1, 10)
    steps = [
        F.concat(*[p for text in step.split("{entity}") for p in (F.lit(text), entity)][:-1]) for step in finding.steps
    ]
    return F.struct(
        F.format_string(finding.cause, *finding.cause_values).alias("probable_cause"),
        F.lit(finding.category).alias("cause_category"),
        F.lit(finding.confidence).alias("confidence"),
        F.lit(finding.urgency).alias("urgency"),
        F.array(*steps).alias("remediation_steps"),
    )


def diagnose(drift: DataFrame) -> DataFrame:
    """One diagnosis per row of ``(feature_name, psi_score, ks_p_value, z_score)``; the first rule that holds."""
    scored = drift.withColumn("abs_z", F.abs("z_score"))
    finding = (
        F.when((F.col("psi_score") > 0.2) & (F.col("abs_z") > 3.0), _as_struct(_DELAY))
        .when(F.col("psi_score") > 0.1, _as_struct(_QUALITY))
        .when(F.col("ks_p_value") < 0.05, _as_struct(_SEASON))
        .otherwise(_as_struct(_UNKNOWN))
    )
    return scored.withColumn("finding", finding).select(
        "feature_name",
        "finding.probable_cause",
        "finding.cause_category",
        "finding.confidence",
        F.array("feature_name").alias("affected_features"),
        "finding.remediation_steps",
        "finding.urgency",
        F.format_string(_IMPACT, "feature_name").alias("estimated_impact"),
        F.lit(_MODEL).alias("model_used"),
        F.lit(0).alias("tokens_used"),
        F.lit(True).alias("fallback_used"),
    )


def most_severe_first(report: DataFrame) -> DataFrame:
    """Drifting features by PSI; rows are features, so the order is over a handful."""
    return report.filter("is_drifting").orderBy(F.col("psi_score").desc(), "feature_name")


def diagnosis_context(drift: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """``(feature_name, context)``: a JSON document of the metrics, their reading and what is registered.

    ``drift`` also has ``severity``, ``baseline_period``, ``current_period``, ``sample_size`` and ``computed_at``
    in epoch seconds.
    """
    time = F.date_format(F.timestamp_seconds(F.floor("computed_at")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = [
        "feature_name",
        F.struct(
            "psi_score",
            psi_reading(F.col("psi_score")).alias("psi_interpretation"),
            "ks_statistic",
            "ks_p_value",
            (F.col("ks_p_value") < 0.05).alias("ks_significant"),
            "z_score",
            (F.abs("z_score") > 3.0).alias("z_score_anomalous"),
            "kl_divergence",
        ).alias("drift_metrics"),
        "severity",
        F.struct("baseline_period", "current_period", "sample_size", time.alias("analysis_timestamp")).alias("time_context"),
    ]
    if registry is not None:
        described = registry.select(
            "feature_name",
            F.struct("description", "transform_logic", "window_type", "freshness_sla_seconds", "owner").alias(
                "feature_metadata"
            ),
        )
        drift = drift.join(described, "feature_name", "left")
        parts.append("feature_metadata")
    return drift.select("feature_name", F.to_json(F.struct(*parts)).alias("context"))
