"""The feature registry: definitions, their lineage, and how they are listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFINITION_SCHEMA = """
    feature_name string, display_name string, description string, transform_logic string, window_type string,
    freshness_sla_seconds int, owner string, version string, is_active boolean
"""
LINEAGE_SCHEMA = "feature_name string, step int, upstream_source string, transform_step string"

# The registered features.
_DEFINITIONS = [
    (
        "txn_count_5m",
        "Transaction Count (5 min)",
        "Number of purchase transactions in the last 5-minute tumbling window.",
        "COUNT(event_type='purchase') OVER TUMBLING WINDOW 5 MINUTES",
        "tumbling_5m",
        60,
        "ml-platform",
    ),
    (
        "avg_spend_1h",
        "Average Spend (1 hour)",
        "Average purchase transaction amount in a sliding 1-hour window.",
        "AVG(transaction_amount WHERE event_type='purchase') OVER SLIDING WINDOW 1H/5MIN",
        "sliding_1h",
        300,
        "ml-platform",
    ),
    (
        "session_activity_rate",
        "Session Activity Rate (5 min)",
        "Ratio of total events to distinct sessions in the last 5 minutes.",
        "COUNT(events) / COUNT(DISTINCT session_id) OVER TUMBLING WINDOW 5 MINUTES",
        "tumbling_5m",
        60,
        "ml-platform",
    ),
    (
        "cart_abandon_ratio",
        "Cart Abandonment Ratio (30 min)",
        "Fraction of add-to-cart events not followed by a purchase in 30 minutes.",
        "add_to_cart_count_without_purchase / total_add_to_cart OVER TUMBLING 30 MINUTES",
        "tumbling_30m",
        300,
        "ml-platform",
    ),
    (
        "product_interaction_freq",
        "Product Interaction Frequency (1 hour)",
        "Number of product page views in the last 1-hour tumbling window.",
        "COUNT(event_type='page_view') OVER TUMBLING WINDOW 1 HOUR",
        "tumbling_1h",
        300,
        "ml-platform",
    ),
    (
        "anomaly_score",
        "Transaction Anomaly Score (5 min)",
        "Z-score of current transaction amount vs 24-hour rolling mean/stddev. "
        "High values indicate potential fraud.",
        "(avg_txn_5m - mean_24h) / stddev_24h",
        "tumbling_5m",
        60,
        "fraud-detection",
    ),
]

# Each feature comes from the event topic by a filter and from the stream by an aggregation.
_EVENTS, _STREAM = "kafka:ecommerce.events.raw", "pyspark:structured_streaming"
_TRANSFORM_STEPS = {
    "txn_count_5m": ("filter event_type=purchase", "count_window_5m"),
    "avg_spend_1h": ("filter event_type=purchase", "avg_window_1h"),
    "session_activity_rate": ("all_events", "session_rate_5m"),
    "cart_abandon_ratio": ("filter add_to_cart + purchase", "cart_abandon_30m"),
    "product_interaction_freq": ("filter page_view", "pageview_count_1h"),
    "anomaly_score": ("filter purchase", "zscore_24h"),
}


def seed_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, "1.0", True) for row in _DEFINITIONS], DEFINITION_SCHEMA)


def seed_lineage(spark: SparkSession) -> DataFrame:
    rows = [
        (name, step, source, transform)
        for name, transforms in _TRANSFORM_STEPS.items()
        for step, (source, transform) in enumerate(zip((_EVENTS, _STREAM), transforms), start=1)
    ]
    return spark.createDataFrame(rows, LINEAGE_SCHEMA)


def missing_seeds(existing: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds whose name is not registered yet."""
    return seeds.join(existing.select("feature_name"), "feature_name", "left_anti").select(*seeds.columns)


def with_lineage(definitions: DataFrame, lineage: DataFrame) -> DataFrame:
    """Definitions with their lineage nested in step order; an empty array where there is none."""
    step = F.struct("step", "upstream_source", "transform_step")
    nested = lineage.groupBy("feature_name").agg(F.array_sort(F.collect_list(step)).alias("lineage"))
    nothing = F.array().cast(nested.schema["lineage"].dataType)
    return definitions.join(nested, "feature_name", "left").withColumn("lineage", F.coalesce("lineage", nothing))


def list_features(definitions: DataFrame, lineage: DataFrame) -> DataFrame:
    """Active features by name."""
    return with_lineage(definitions.filter("is_active"), lineage).orderBy("feature_name")


def get_feature(definitions: DataFrame, lineage: DataFrame, name: str) -> DataFrame:
    """The named feature, active or not; empty if it is not registered."""
    named = F.col("feature_name") == name
    return with_lineage(definitions.filter(named), lineage.filter(named))


def describe(rows: DataFrame, definitions: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows by feature with registry columns beside them, null where a feature is not registered."""
    return rows.join(definitions.select("feature_name", *columns), "feature_name", "left")
