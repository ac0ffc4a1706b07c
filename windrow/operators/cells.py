"""Base cells: one row per user and base window, from which every longer window is assembled.

Cells are what batch and streaming share. They are the only place raw events are aggregated,
and both grains combine on the map side, so a user holding a third of all events costs that user's
number of cells and not its number of events after the first shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = "5 minutes"
CELL_KEY = ["user_id", "window_start", "window_end"]


def _measures() -> list[Column]:
    kind = F.col("event_type")
    amount = F.when(kind == "purchase", F.col("transaction_amount"))
    return [
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(kind == "purchase").alias("n_purchases"),
        F.count_if(kind == "add_to_cart").alias("n_carts"),
        F.count_if(kind == "page_view").alias("n_views"),
        # Amounts as count, sum and sum of squares about their mean: unlike sums of raw squares these
        # can be combined without cancellation when the amounts are large and close together.
        F.count(amount).alias("n_amounts"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("sum_amount"),
        F.coalesce(F.var_pop(amount) * F.count(amount), F.lit(0.0)).alias("m2_amount"),
    ]


def _flatten(grouped: DataFrame) -> DataFrame:
    measures = [c for c in grouped.columns if c not in ("user_id", "w")]
    return grouped.select(
        "user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *measures
    )


def cells(events: DataFrame, base: str = BASE) -> DataFrame:
    """Batch cells. The distinct count spreads a cell over its sessions before it is merged."""
    return _flatten(
        events.groupBy("user_id", F.window("timestamp", base).alias("w")).agg(
            *_measures(), F.count_distinct("session_id").alias("n_sessions")
        )
    )


def session_cells(events: DataFrame, base: str = BASE) -> DataFrame:
    """Cells split by session: the form Structured Streaming can keep.

    A streaming aggregation may not count distinct values, and a set of session ids per cell would
    grow without bound in the state store, so the session id is part of the key instead.
    """
    return _flatten(
        events.groupBy("user_id", F.window("timestamp", base).alias("w"), "session_id").agg(*_measures())
    )


def fold_cells(split: DataFrame) -> DataFrame:
    """Session cells to cells, equal to ``cells`` of the same events.

    The spread of amounts about the cell's own mean needs that mean first; joining it back keeps
    both steps plain aggregations, so no cell is ever held by one task.
    """
    own_mean = F.col("sum_amount") / F.nullif(F.col("n_amounts"), F.lit(0))
    center = split.groupBy(*CELL_KEY).agg(
        (F.sum("sum_amount") / F.nullif(F.sum("n_amounts"), F.lit(0))).alias("center")
    )
    gap = F.coalesce(own_mean - F.col("center"), F.lit(0.0))
    return (
        split.join(center, CELL_KEY)
        .groupBy(*CELL_KEY)
        .agg(
            *[
                F.sum(c).alias(c)
                for c in ("n_events", "n_purchases", "n_carts", "n_views", "n_amounts", "sum_amount")
            ],
            F.sum(F.col("m2_amount") + F.col("n_amounts") * gap * gap).alias("m2_amount"),
            F.count("session_id").alias("n_sessions"),
        )
    )
