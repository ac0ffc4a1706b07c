"""Distribution comparison per feature: PSI, Kolmogorov-Smirnov, Z score, KL divergence, histograms, summaries.

Input is the long form ``(feature_name, side, value)``. Raw rows are only ever aggregated with map-side
combine; joins are against one row per named feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.columns import EPSILON, bin_index
from windrow.functions.kolmogorov import p_value
from windrow.operators.ranks import checked, sketched_cuts, wide_quantiles, with_range
from windrow.operators.samples import BASELINE, CURRENT, of_features

# Bins, widening of the last edge and smoothing of densities.
N_BINS = 10
_KL_WIDEN = 1e-9
_KL_SMOOTH = 1e-10


def _base() -> Column:
    return F.col("side") == BASELINE


def _curr() -> Column:
    return F.col("side") == CURRENT


# PSI -----------------------------------------------------------------------------------------------------


def psi_bin(value: str, low: str, high: str, n_bins: int = N_BINS) -> Column:
    """Bin 1..n of the baseline's range cut into equal parts, null outside it.

    Bins are closed on the left; the last is closed on both sides and widened a little.
    """
    index = bin_index(value, low, f"({high} - {low}) / {n_bins}D", n_bins)
    return F.expr(f"CASE WHEN {value} >= {low} AND {value} <= {high} + {EPSILON}D THEN {index} END")


def psi_score(base: str, curr: str, n_base: str, n_curr: str, low: str, high: str) -> Column:
    """PSI from arrays of counts per bin. Shares divide by all values of the side, binned or not."""

    def share(count: str, n: str) -> str:
        return f"if({count} = 0, {EPSILON}D, {count} / ({n} + {EPSILON}D))"

    p, q = share("b", n_base), share("c", n_curr)
    terms = f"zip_with({base}, {curr}, (b, c) -> ({q} - {p}) * ln({q} / {p}))"
    return F.expr(f"if({_comparable(n_base, n_curr, low, high)}, round(greatest({_sum(terms)}, 0D), 6), 0D)")


def _sum(array: str) -> str:
    return f"aggregate({array}, 0D, (so_far, x) -> so_far + x)"


def _comparable(n_base: str, n_curr: str, low: str, high: str) -> str:
    return f"{n_base} > 0 AND {n_curr} > 0 AND {low} < {high}"


def counts_per_bin(bin_column: str, n: str, n_bins: int = N_BINS) -> Column:
    """Aggregate: array of the sums of ``n`` in bins 1..n_bins."""
    sums = (f"coalesce(sum({n}) FILTER (WHERE {bin_column} = {i}), 0)" for i in range(1, n_bins + 1))
    return F.expr(f"array({', '.join(sums)})")


def _binned(samples: DataFrame, edges: DataFrame, bin_of, n_bins: int) -> DataFrame:
    """Per feature the edges' columns and the arrays of counts ``base`` and ``curr``."""
    constants = ("low", "high", "n_base", "n_curr")
    return (
        samples.join(F.broadcast(checked(edges)), "feature_name")
        .withColumn("bin", bin_of("value", "low", "high", n_bins))
        .groupBy("feature_name", *constants, "bin")
        .agg(F.count_if(_base()).alias("base"), F.count_if(_curr()).alias("curr"))
        .groupBy("feature_name", *constants)
        .agg(counts_per_bin("bin", "base", n_bins).alias("base"), counts_per_bin("bin", "curr", n_bins).alias("curr"))
    )


_SCORED = ("base", "curr", "n_base", "n_curr", "low", "high")


def psi(samples: DataFrame, n_bins: int = N_BINS, features: Sequence[str] | None = None) -> DataFrame:
    """``(feature_name, psi_score)``; 0.0 if a side is empty or the baseline is constant."""
    samples = of_features(samples, features)
    value = F.col("value")
    edges = samples.groupBy("feature_name").agg(
        F.min(F.when(_base(), value)).alias("low"),
        F.max(F.when(_base(), value)).alias("high"),
        F.count_if(_base()).alias("n_base"),
        F.count_if(_curr()).alias("n_curr"),
    )
    return _binned(samples, edges, psi_bin, n_bins).select("feature_name", psi_score(*_SCORED).alias("psi_score"))


# KL ------------------------------------------------------------------------------------------------------


def kl_bin(value: str, low: str, high: str, n_bins: int = N_BINS) -> Column:
    return F.expr(bin_index(value, low, f"({high} + {_KL_WIDEN}D - {low}) / {n_bins}D", n_bins))


def kl_score(base: str, curr: str, n_base: str, n_curr: str, low: str, high: str) -> Column:
    """KL(baseline || current) of the smoothed, renormalised densities over the joint range."""
    width = f"(({high} + {_KL_WIDEN}D - {low}) / size({base}))"

    def density(counts: str, n: str) -> str:
        return f"transform({counts}, x -> try_divide(try_divide(x, {n}), {width}) + {_KL_SMOOTH}D)"

    p, q = density(base, n_base), density(curr, n_curr)
    score = f"zip_with({p}, {q}, (a, b) -> a / {_sum(p)} * ln((a / {_sum(p)}) / (b / {_sum(q)})))"
    # A joint range without width has both sides constant and equal.
    return F.expr(f"if({_comparable(n_base, n_curr, low, high)}, {_sum(score)}, 0D)")


def kl_divergence(samples: DataFrame, n_bins: int = N_BINS, features: Sequence[str] | None = None) -> DataFrame:
    samples = of_features(samples, features)
    value = F.col("value")
    edges = samples.groupBy("feature_name").agg(
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.count_if(_base()).alias("n_base"),
        F.count_if(_curr()).alias("n_curr"),
    )
    return _binned(samples, edges, kl_bin, n_bins).select("feature_name", kl_score(*_SCORED).alias("kl_divergence"))


# Z score -------------------------------------------------------------------------------------------------


def z_columns(mean_base: str, std_base: str, mean_curr: str, comparable: str, threshold: float) -> list[Column]:
    std = f"({std_base} + {EPSILON}D)"
    z = f"(abs({mean_curr} - {mean_base}) / {std})"
    return [
        F.expr(f"if({comparable}, round({mean_curr}, 4), 0D)").alias("current_mean"),
        F.expr(f"if({comparable}, round({mean_base}, 4), 0D)").alias("baseline_mean"),
        F.expr(f"if({comparable}, round({std}, 4), 1D)").alias("baseline_std"),
        F.expr(f"if({comparable}, round({z}, 4), 0D)").alias("z_score"),
        F.expr(f"if({comparable}, {z} > {threshold}D, false)").alias("is_anomalous"),
    ]


def z_score(samples: DataFrame, threshold: float = 3.0, features: Sequence[str] | None = None) -> DataFrame:
    """Distance of the means in population standard deviations of the baseline. One pass."""
    value = F.col("value")
    moments = of_features(samples, features).groupBy("feature_name").agg(
        F.avg(F.when(_base(), value)).alias("mean_base"),
        F.stddev_pop(F.when(_base(), value)).alias("std_base"),
        F.avg(F.when(_curr(), value)).alias("mean_curr"),
    )
    comparable = "(mean_base IS NOT NULL AND mean_curr IS NOT NULL)"
    return moments.select("feature_name", *z_columns("mean_base", "std_base", "mean_curr", comparable, threshold))


# Kolmogorov-Smirnov --------------------------------------------------------------------------------------


def tally(samples: DataFrame) -> DataFrame:
    """Counts of both sides per distinct value: what a value held by a third of the rows shrinks to."""
    return samples.groupBy("feature_name", "value").agg(
        F.count_if(_base()).alias("base"), F.count_if(_curr()).alias("curr")
    )


def _share(count: Column, n: str) -> Column:
    """Null for a side without values, which has no distribution function."""
    return F.try_divide(F.coalesce(count, F.lit(0)), F.col(n))


def range_gaps(ranged: DataFrame, *more_keys: str, aggregates: Sequence[Column] = ()) -> DataFrame:
    """Per value range the extremes of F_base - F_curr counted from the range's start, and its totals.

    ``ranged`` has ``range_id``, ``base``, ``curr`` and the sizes ``n_base``, ``n_curr`` of the sides.
    """
    upto = Window.partitionBy("feature_name", "range_id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    gap = _share(F.sum("base").over(upto), "n_base") - _share(F.sum("curr").over(upto), "n_curr")
    return (
        ranged.withColumn("gap", gap)
        .groupBy("feature_name", "range_id", *more_keys)
        .agg(
            F.sum("base").alias("base"),
            F.sum("curr").alias("curr"),
            F.min("gap").alias("min_gap"),
            F.max("gap").alias("max_gap"),
            *aggregates,
        )
    )


def with_largest_gap(gaps: DataFrame) -> DataFrame:
    """Adds ``d``: the largest |F_base - F_curr| inside the range, now counted from the lowest value.

    The offset of a range shifts all its gaps alike, so the extremes inside it are enough and the
    values themselves need not be read again. Runs over at most a thousand ranges a feature.
    """
    lower = Window.partitionBy("feature_name").orderBy("range_id").rangeBetween(Window.unboundedPreceding, -1)
    offset = _share(F.sum("base").over(lower), "n_base") - _share(F.sum("curr").over(lower), "n_curr")
    return gaps.withColumn("offset", offset).withColumn(
        "d", F.greatest(F.abs(F.col("offset") + F.col("min_gap")), F.abs(F.col("offset") + F.col("max_gap")))
    )


def with_ks(frame: DataFrame, alpha: float, method: str) -> DataFrame:
    """Adds statistic, p and significance to rows of ``d``, ``n_base`` and ``n_curr``."""
    comparable = "n_base > 0 AND n_curr > 0"
    known = frame.withColumn("d", F.expr(f"if({comparable}, d, 0D)"))
    p = F.when(F.expr(comparable), p_value("n_base", "n_curr", "d", method)).otherwise(F.lit(1.0))
    return known.withColumn("_p", p).withColumns(
        {
            "ks_statistic": F.round("d", 6),
            "ks_p_value": F.round("_p", 6),
            "ks_significant": F.col("_p") < alpha,
        }
    )


def ks_2samp(
    samples: DataFrame, alpha: float = 0.05, method: str = "asymptotic", features: Sequence[str] | None = None
) -> DataFrame:
    """Two-sample KS statistic over any number of distinct values, and its two-sided p by ``method``."""
    counted = tally(of_features(samples, features))
    sides = counted.groupBy("feature_name").agg(
        F.sum("base").alias("n_base"), F.sum("curr").alias("n_curr"), sketched_cuts("value").alias("cuts")
    )
    ranged = with_range(counted.join(F.broadcast(checked(sides)), "feature_name"))
    largest = with_largest_gap(range_gaps(ranged, "n_base", "n_curr"))
    per_feature = largest.groupBy("feature_name").agg(
        F.max("d").alias("d"), F.max("n_base").alias("n_base"), F.max("n_curr").alias("n_curr")
    )
    if method == "exact":
        # A feature's walk takes a task long: each gets its own, where one would take them all.
        per_feature = per_feature.repartition(per_feature.sparkSession.sparkContext.defaultParallelism)
    return with_ks(per_feature, alpha, method).select("feature_name", "ks_statistic", "ks_p_value", "ks_significant")


# Histograms and summaries --------------------------------------------------------------------------------


def histogram(samples: DataFrame, n_bins: int = 30, features: Sequence[str] | None = None) -> DataFrame:
    """Equal-width counts ``(feature_name, bin, lower, upper, n)``, empty bins included.

    Samples without a ``side`` are one series; otherwise both sides share the edges and are counted apart.
    """
    samples = of_features(samples, features)
    split = "side" in samples.columns
    value = F.col("value")
    extent = samples.groupBy("feature_name").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    # A constant series gets a range of one around its value.
    flat = F.col("low") == F.col("high")
    extent = extent.select(
        "feature_name",
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    ).withColumn("width", (F.col("high") - F.col("low")) / F.lit(float(n_bins)))
    counts = {"n_baseline": _base(), "n_current": _curr()} if split else {"n": F.lit(True)}
    per_bin = (
        samples.join(F.broadcast(checked(extent)), "feature_name")
        .withColumn("bin", F.expr(bin_index("value", "low", "width", n_bins)))
        .groupBy("feature_name", "low", "width", "bin")
        .agg(*[F.count_if(condition).alias(name) for name, condition in counts.items()])
        .groupBy("feature_name", "low", "width")
        .agg(*[counts_per_bin("bin", name, n_bins).alias(name) for name in counts])
    )
    zipped = F.arrays_zip(F.sequence(F.lit(1), F.lit(n_bins)).alias("bin"), *[F.col(name) for name in counts])
    return per_bin.select("feature_name", "low", "width", F.explode(zipped).alias("b")).select(
        "feature_name",
        "b.bin",
        (F.col("low") + (F.col("b.bin") - 1) * F.col("width")).alias("lower"),
        (F.col("low") + F.col("b.bin") * F.col("width")).alias("upper"),
        *[f"b.{name}" for name in counts],
    )


def feature_summary(samples: DataFrame, features: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Count, mean, population deviation, median, 95th percentile and maximum, to three digits."""
    samples = of_features(samples, features)
    moments = samples.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 3).alias("mean"),
        F.round(F.stddev_pop("value"), 3).alias("std"),
        F.round(F.max("value"), 3).alias("max"),
    )
    ranks = wide_quantiles(samples, {"p50": 0.5, "p95": 0.95}, "feature_name", "value", approximate)
    return moments.join(F.broadcast(checked(ranks)), "feature_name").select(
        "feature_name", "n", "mean", "std", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"), "max"
    )


def box_stats(samples: DataFrame, features: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Quartiles and range per feature."""
    samples = of_features(samples, features)
    extent = samples.groupBy("feature_name").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = wide_quantiles(samples, {"q1": 0.25, "median": 0.5, "q3": 0.75}, "feature_name", "value", approximate)
    return extent.join(F.broadcast(checked(quartiles)), "feature_name").select("feature_name", "min", "q1", "median", "q3", "max")
