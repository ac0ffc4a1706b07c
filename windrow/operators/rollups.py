"""Totals at several levels in one pass, by grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levels(rows: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], measures: Sequence[Column]) -> DataFrame:
    """``rows`` aggregated by each of ``sets`` of ``keys``, with ``level``, whose bits say which keys a row leaves out.

    The first key is the highest bit. One pass and one shuffle: each row is expanded to its sets and aggregated before
    it leaves its task. A key that a level leaves out is null there, and ``level`` tells that from a null of its own.
    """
    expanded = rows.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys))
    return expanded.agg(F.grouping_id().alias("level"), *measures)


def activity_levels(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Events and revenue by day, type and the user's segment, at every level of interest.

    ``segments(user_id, segment)`` has a row per user. Users without one have a null segment.
    """
    rows = events.join(segments, "user_id", "left").select(
        F.to_date("timestamp").alias("day"), "event_type", "segment", F.col("transaction_amount").cast("decimal(18,6)").alias("amount")
    )
    keys = ["day", "event_type", "segment"]
    sets = [keys, ["day", "event_type"], ["day", "segment"], ["day"], ["event_type"], ["segment"], []]
    events_here = F.count(F.lit(1))
    return levels(
        rows,
        keys,
        sets,
        [
            events_here.alias("events"),
            F.round(F.sum("amount").cast("double"), 6).alias("revenue"),
            F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        ],
    )


def drift_levels(samples: DataFrame) -> DataFrame:
    """How values fall on the two sides and on the features: counts and shares, by side and feature, at all levels (cube)."""
    cubed = samples.cube("feature_name", "side").agg(
        F.grouping_id().alias("level"),
        F.count("value").alias("n"),
        F.count_if(F.col("value") == 0).alias("zeros"),
        F.round(F.min("value"), 6).alias("low"),
        F.round(F.max("value"), 6).alias("high"),
    )
    return cubed.withColumn("zero_share", F.round(F.try_divide("zeros", "n"), 6))
