"""Adapter from the supplied ``events`` table to the event model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How the table's event types map to the model's.
EVENT_TYPE_OF = {
    "view": "page_view",
    "click": "add_to_cart",
    "purchase": "purchase",
    "signup": "search",
    "error": "abandon",
}


def _event_type() -> Column:
    chain = F
    for source, target in EVENT_TYPE_OF.items():
        chain = chain.when(F.col("event_type") == source, target)
    return chain


def user_name(number: str) -> Column:
    """``usr_%05d`` of a number, without the formatter's cost per row."""
    digits = F.col(number).cast("string")
    padded = F.when(F.col(number).between(0, 99_999), F.lpad(digits, 5, "0")).otherwise(digits)
    return F.concat(F.lit("usr_"), padded)


def read_activity(spark: SparkSession, folder: str) -> DataFrame:
    return as_events(spark.read.parquet(f"{folder}/events.parquet"))


def as_events(table: DataFrame) -> DataFrame:
    """Only the columns a plan uses are read; ``ts`` keeps its type (no zone in the files)."""
    return table.select(
        F.col("event_id").cast("string").alias("event_id"),
        user_name("user_id").alias("user_id"),
        F.get_json_object("props", "$.k").alias("session_id"),
        _event_type().alias("event_type"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(F.lit(0.0)).alias("transaction_amount"),
    )
