"""Long form of feature values: ``(feature_name, side, value)``, side being baseline or current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.schema import FEATURES

BASELINE, CURRENT = "baseline", "current"


def wide_to_long(vectors: DataFrame, features: Sequence[str] = FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per vector and feature; values that do not read as a number are skipped."""
    as_double = [F.col(c).try_cast("double").alias(c) for c in features]
    long = vectors.select(*keep, *as_double).unpivot(list(keep), list(features), "feature_name", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def two_sided(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Both sides in one frame, from long frames with ``feature_name`` and ``value``."""
    columns = ["feature_name", "value"]
    return (
        baseline.select(*columns, F.lit(BASELINE).alias("side"))
        .unionByName(current.select(*columns, F.lit(CURRENT).alias("side")))
        .select("feature_name", "side", "value")
    )


def of_features(samples: DataFrame, features: Sequence[str] | None) -> DataFrame:
    """Samples of all features, or of the named ones."""
    return samples if features is None else samples.filter(F.col("feature_name").isin(*features))
