"""Point-in-time training sets: to each label the vector that was current at the label's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.time import epoch, seconds, whole_multiple
from windrow.operators.cells import BASE


def point_in_time(
    labels: DataFrame,
    vectors: DataFrame,
    *,
    key: str = "user_id",
    label_time: str = "label_ts",
    vector_time: str = "window_end",
    grid: str = BASE,
    max_age: str | None = None,
    block: str = "7 days",
) -> DataFrame:
    """``labels`` with the latest vector having ``vector_time <= label_time``; nulls where there is none
    or it is older than ``max_age``.

    ``vector_time`` lies on ``grid`` (window ends do), so all labels of one key in one grid step share
    their answer. The answer is found once per step over groups of one key and ``block``, whose size the
    grid bounds; labels then look it up by equality. Many labels on one key or one step are a skewed
    equi-join, which adaptive execution splits, rather than an oversized window group.
    """
    per_block = whole_multiple(block, grid)
    vector_columns = [c for c in vectors.columns if c != key]
    label_slot = F.floor(epoch(label_time) / seconds(grid))
    known = vectors.select(
        key, F.floor(epoch(vector_time) / seconds(grid)).alias("_slot"), F.struct(*vector_columns).alias("_vector")
    )
    missing = F.lit(None).cast(known.schema["_vector"].dataType)
    asked = labels.select(key, label_slot.alias("_slot")).distinct()
    rows = asked.select("*", missing.alias("_vector"), F.lit(True).alias("_asked")).unionByName(
        known.withColumn("_asked", F.lit(False))
    )
    # Within a step the vector comes first: it ends at the step's start, no label of it is earlier.
    in_block = Window.partitionBy(key, "_block").orderBy("_slot", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    so_far = rows.withColumn("_block", F.floor(F.col("_slot") / per_block)).withColumn(
        "_vector", F.last("_vector", ignorenulls=True).over(in_block)
    )
    # What a block starts from is the last vector of the blocks before it; there are few blocks per key.
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        so_far.groupBy(key, "_block")
        .agg(F.max_by("_vector", F.struct("_slot", "_asked")).alias("_carried"))
        .withColumn("_carried", F.last("_carried", ignorenulls=True).over(before))
    )
    answers = (
        so_far.filter("_asked")
        .join(carried, [key, "_block"], "left")
        .select(key, "_slot", F.coalesce("_vector", "_carried").alias("_vector"))
    )
    found = labels.withColumn("_slot", label_slot).join(answers, [key, "_slot"], "left")
    vector = F.col("_vector")
    if max_age is not None:
        age = epoch(label_time) - epoch(F.col(f"_vector.{vector_time}"))
        vector = F.when(age <= seconds(max_age), vector)
    found = found.withColumn("_vector", vector)
    return found.select(*labels.columns, *[F.col(f"_vector.{c}").alias(c) for c in vector_columns])
