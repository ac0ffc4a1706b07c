"""The feature vector: one row per user and base window having a purchase.

Alignment. For a base window ``[s, e)`` every feature is taken from windows that are closed at ``e``:
sliding ones from the window ending at ``e``, tumbling ones from the last window ending at or before
``e``. A training row therefore never contains anything that happened after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.columns import EPSILON, ratio
from windrow.functions.time import bound, epoch, seconds, shift, whole_multiple
from windrow.operators.cells import BASE, cells
from windrow.schema import FEATURES


@dataclass(frozen=True)
class Widths:
    """Window widths of the vector; every width is a whole multiple of ``base``."""

    base: str = BASE
    spend: str = "1 hour"
    carts: str = "30 minutes"
    views: str = "1 hour"
    history: str = "24 hours"

    def __post_init__(self):
        for width in (self.spend, self.carts, self.views, self.history):
            whole_multiple(width, self.base)

    @property
    def lookback(self) -> int:
        """Seconds before a base window that its vector can depend on."""
        return max(
            seconds(self.spend), seconds(self.history), 2 * seconds(self.carts), 2 * seconds(self.views)
        )


REFERENCE_WIDTHS = Widths()
DENSE_WIDTHS = Widths(base="1 day", spend="7 days", carts="1 day", views="1 day", history="7 days")

# Groups span this many lookbacks, so one cell in eight is copied to the next group.
_BLOCK_LOOKBACKS = 8


def in_time_blocks(rows: DataFrame, start: Column, lookback: int) -> DataFrame:
    """Adds ``block`` and ``home``: each row in its own stretch of time and, where later rows may
    look back at it, once more in the next one.

    Frames partitioned by ``(user_id, block)`` see all they need, while a group holds a bounded
    number of cells however long a user's history is, and one user spreads over many tasks.
    """
    size = _BLOCK_LOOKBACKS * lookback
    own = F.floor(start / size)
    reaches_next = start >= (own + 1) * size - lookback
    blocks = F.when(reaches_next, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.select("*", F.explode(blocks).alias("block")).withColumn("home", F.col("block") == own)


def vector_from_cells(cell: DataFrame, widths: Widths = REFERENCE_WIDTHS, computed_at: Column | None = None) -> DataFrame:
    """Vectors of all cells having a purchase. ``computed_at`` defaults to the window's start.

    One shuffle, on ``(user_id, block)``, serves all frames; nothing is joined.
    """
    base = seconds(widths.base)
    # Cells without purchase, cart or view can influence no vector.
    useful = cell.filter(F.col("n_purchases") + F.col("n_carts") + F.col("n_views") > 0)
    timed = useful.select(
        "*",
        epoch("window_start").alias("t"),
        *[F.floor(epoch("window_start") / seconds(w)).alias(c) for c, w in (("cart_slot", widths.carts), ("view_slot", widths.views))],
    )
    group = Window.partitionBy("user_id", "block")
    n, amounts = F.col("n_amounts"), F.col("sum_amount")

    # For the spread, amounts are shifted by the mean of the whole group, which cancels out of it.
    center = ratio(F.sum(amounts).over(group), F.sum(n).over(group))
    rows = in_time_blocks(timed, F.col("t"), widths.lookback).withColumn("s1", amounts - n * center)
    s1, s2 = F.col("s1"), F.col("m2_amount") + F.when(n > 0, F.col("s1") * F.col("s1") / n).otherwise(F.lit(0.0))

    def ending_here(measure: Column, width: str) -> Column:
        return F.sum(measure).over(group.orderBy("t").rangeBetween(base - seconds(width), 0))

    def last_closed(measure: str, slot: str, width: str) -> Column:
        # A tumbling window is closed at the end of its last cell; before that its predecessor counts.
        by_slot = group.orderBy(slot)
        closes = (F.col("t") + base) % seconds(width) == 0
        own = F.sum(measure).over(by_slot.rangeBetween(0, 0))
        before = F.sum(measure).over(by_slot.rangeBetween(-1, -1))
        return F.coalesce(F.when(closes, own).otherwise(before), F.lit(0))

    rows = rows.withColumns(
        {
            "spend_n": ending_here(n, widths.spend),
            "spend_sum": ending_here(amounts, widths.spend),
            "hist_n": ending_here(n, widths.history),
            "hist_sum": ending_here(amounts, widths.history),
            "hist_s1": ending_here(s1, widths.history),
            "hist_s2": ending_here(s2, widths.history),
            "closed_carts": last_closed("n_carts", "cart_slot", widths.carts),
            "closed_buys": last_closed("n_purchases", "cart_slot", widths.carts),
            "closed_views": last_closed("n_views", "view_slot", widths.views),
        }
    )

    mean_history = ratio(F.col("hist_sum"), F.col("hist_n"))
    spread = F.greatest(F.col("hist_s2") - F.col("hist_s1") * F.col("hist_s1") / F.col("hist_n"), F.lit(0.0))
    deviation = F.when(F.col("hist_n") > 1, F.sqrt(spread / (F.col("hist_n") - 1))).otherwise(F.lit(1.0))
    score = F.abs((amounts / n - mean_history) / (deviation + F.lit(EPSILON)))
    carts, buys = F.col("closed_carts"), F.col("closed_buys")

    return rows.filter(F.col("home") & (F.col("n_purchases") > 0)).select(
        "user_id",
        "window_start",
        "window_end",
        (F.col("t") if computed_at is None else computed_at).cast("double").alias("computed_at"),
        F.col("n_purchases").cast("double").alias("txn_count_5m"),
        ratio(F.col("spend_sum"), F.col("spend_n")).alias("avg_spend_1h"),
        ratio(F.col("n_events"), F.col("n_sessions")).alias("session_activity_rate"),
        F.greatest(ratio(carts - buys, carts), F.lit(0.0)).alias("cart_abandon_ratio"),
        F.col("closed_views").cast("double").alias("product_interaction_freq"),
        # Without an amount in the window there is nothing to score.
        F.when(n > 0, score).otherwise(F.lit(0.0)).alias("anomaly_score"),
    )


def feature_vector(events: DataFrame, widths: Widths = REFERENCE_WIDTHS, computed_at: Column | None = None) -> DataFrame:
    return vector_from_cells(cells(events, widths.base), widths, computed_at)


def backfill_vector(
    events: DataFrame, start, end, widths: Widths = REFERENCE_WIDTHS, computed_at: Column | None = None
) -> DataFrame:
    """Vectors of the windows starting in ``[start, end]`` (UTC), both inclusive, from the events up to ``end``.

    Events are read from one lookback before ``start``, so the first windows have their history.
    """
    first = shift(bound(start), -widths.lookback)
    ranged = events.filter((F.col("timestamp") >= first) & (F.col("timestamp") <= bound(end)))
    return feature_vector(ranged, widths, computed_at).filter(F.col("window_start").between(bound(start), bound(end)))


def training_projection(vectors: DataFrame) -> DataFrame:
    """The columns a model trains on."""
    return vectors.select("user_id", *FEATURES, "computed_at", "event_date")
