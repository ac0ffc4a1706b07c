"""The single features, each ``(events, width[, slide]) -> (user_id, window_start, window_end, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.columns import ratio
from windrow.functions.time import seconds, shift, whole_multiple
from windrow.operators.cells import BASE
from windrow.operators.vector import Widths, feature_vector


def _tumbling(events: DataFrame, width: str, *measures: Column) -> DataFrame:
    grouped = events.groupBy("user_id", F.window("timestamp", width).alias("w")).agg(*measures)
    return grouped.select(
        "user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *grouped.columns[2:]
    )


def _of_type(events: DataFrame, *kinds: str) -> DataFrame:
    return events.filter(F.col("event_type").isin(*kinds))


def txn_count(events: DataFrame, width: str = BASE) -> DataFrame:
    return _tumbling(
        _of_type(events, "purchase"), width, F.count(F.lit(1)).cast("double").alias("txn_count_5m")
    )


def product_interaction_freq(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return _tumbling(
        _of_type(events, "page_view"), width, F.count(F.lit(1)).cast("double").alias("product_interaction_freq")
    )


def session_activity_rate(events: DataFrame, width: str = BASE) -> DataFrame:
    """Events per distinct session; 0.0 where no event names a session."""
    return _tumbling(
        events,
        width,
        ratio(F.count(F.lit(1)), F.count_distinct("session_id")).alias("session_activity_rate"),
    )


def abandon_ratio(carts: Column, purchases: Column) -> Column:
    return F.greatest(ratio(carts - purchases, carts), F.lit(0.0))


def cart_abandon_ratio(events: DataFrame, width: str = "30 minutes") -> DataFrame:
    """Share of cart additions in excess of purchases, in windows having either."""
    kind = F.col("event_type")
    return _tumbling(
        _of_type(events, "add_to_cart", "purchase"),
        width,
        abandon_ratio(F.count_if(kind == "add_to_cart"), F.count_if(kind == "purchase")).alias("cart_abandon_ratio"),
    )


def avg_spend(events: DataFrame, width: str = "1 hour", slide: str = BASE) -> DataFrame:
    """Mean purchase amount in every sliding window that holds a purchase.

    Events are first reduced to slide-sized cells, then each cell is copied to the windows over
    it. A two-argument ``window`` would copy every event instead, and its generated code stops
    compiling at a few dozen copies.
    """
    copies = whole_multiple(width, slide)
    amount = F.col("transaction_amount")
    cell = _tumbling(_of_type(events, "purchase"), slide, F.sum(amount).alias("total"), F.count(amount).alias("n"))
    back = (copies - 1) * seconds(slide)
    starts = F.sequence(shift("window_start", -back), F.col("window_start"), F.expr(f"INTERVAL '{seconds(slide)}' SECOND"))
    return (
        cell.select("user_id", "total", "n", F.explode(starts).alias("window_start"))
        .groupBy("user_id", "window_start")
        .agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("avg_spend_1h"))
        .select("user_id", "window_start", shift("window_start", seconds(width)).alias("window_end"), "avg_spend_1h")
    )


def anomaly_score(events: DataFrame, width: str = BASE, history: str = "24 hours") -> DataFrame:
    """Distance of a window's mean purchase from the mean of the history ending with it, in
    sample standard deviations. One row per window having a purchase."""
    widths = Widths(base=width, spend=width, carts=width, views=width, history=history)
    return feature_vector(events, widths).select("user_id", "window_start", "window_end", "anomaly_score")
