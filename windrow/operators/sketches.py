"""Summaries that merge: a day's values and users as sketches, and any span of days by their union.

A day costs one row of a few kilobytes for each feature, whatever the number of values, and a month's percentiles or users are
merged from thirty-one of these instead of read from all rows. Counts, sums and extremes stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.time import bound

# Rank error of a quantile is below 0.3 % at this size, relative error of a user count near 0.8 %.
QUANTILE_SIZE = 1600
USERS_LOG2 = 14
QUANTILES = (0.25, 0.5, 0.75, 0.95, 0.99)


def daily_values(long: DataFrame, day: Column, size: int = QUANTILE_SIZE) -> DataFrame:
    """``(day, feature_name, sketch, n, total, low, high)`` of ``(feature_name, value, ...)``; nulls and NaN are left out."""
    rows = long.select(day.alias("day"), "feature_name", F.col("value").cast("double").alias("value"))
    return (
        rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("day", "feature_name")
        .agg(
            F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"),
            F.count("value").alias("n"),
            F.sum("value").alias("total"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
    )


def daily_users(events: DataFrame, day: Column, log2: int = USERS_LOG2) -> DataFrame:
    """``(day, sketch, events)``: the users of each day, as a sketch, and its events."""
    return events.groupBy(day.alias("day")).agg(
        F.hll_sketch_agg("user_id", F.lit(log2)).alias("sketch"), F.count(F.lit(1)).alias("events")
    )


def summary(daily: DataFrame, since=None, until=None, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """A row per feature over the days ``[since, until]``, from the days' sketches alone."""
    days = daily if since is None else daily.filter(F.col("day") >= bound(since).cast("date"))
    days = days if until is None else days.filter(F.col("day") <= bound(until).cast("date"))
    merged = days.groupBy("feature_name").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
    )
    named = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(quantile_name(q)) for q in quantiles]
    return merged.select("feature_name", "n", (F.col("total") / F.col("n")).alias("mean"), "min", *named, "max")


def quantile_name(q: float) -> str:
    return f"p{round(q * 100):02d}"


def active_users(daily: DataFrame, days: int) -> DataFrame:
    """``(day, users, events)`` over the span of ``days`` that ends with each day, by the union of their sketches.

    A day is copied to the spans it is in, as a sketch; events are not read.
    """
    spans = daily.select(
        F.explode(F.sequence("day", F.date_add("day", days - 1), F.expr("INTERVAL 1 DAY"))).alias("end"), "day", "sketch", "events"
    )
    found = spans.groupBy("end").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"),
        F.sum("events").alias("events"),
        F.max("day").alias("last"),
    )
    # Spans that end after the last day are not whole.
    return found.filter(F.col("end") == F.col("last")).select(F.col("end").alias("day"), "users", "events")


def rank_shares(long: DataFrame, summaries: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """For each feature and quantile the shares of values below and up to the summary's value, to tell its error by."""
    own = summaries.select("feature_name", *(F.col(quantile_name(q)) for q in quantiles))
    both = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).join(F.broadcast(own), "feature_name")
    shares = []
    for q in quantiles:
        name = quantile_name(q)
        shares.append(F.avg((F.col("value") < F.col(name)).cast("double")).alias(f"{name}_below"))
        shares.append(F.avg((F.col("value") <= F.col(name)).cast("double")).alias(f"{name}_upto"))
    return both.groupBy("feature_name").agg(*shares)
