"""Drift report: all four statistics of every feature from one count of the values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.columns import psi_severity
from windrow.operators.distribution import (
    counts_per_bin,
    kl_bin,
    kl_score,
    psi_bin,
    psi_score,
    range_gaps,
    tally,
    with_ks,
    with_largest_gap,
    z_columns,
)
from windrow.operators.ranks import checked, sketched_cuts, with_range
from windrow.operators.samples import of_features


@dataclass(frozen=True)
class DriftThresholds:
    # Default thresholds.
    psi_warn: float = 0.1
    psi_alert: float = 0.2
    ks_alpha: float = 0.05
    z_alert: float = 3.0


def detect_drift(
    samples: DataFrame,
    thresholds: DriftThresholds = DriftThresholds(),
    ks_method: str = "asymptotic",
    features: Sequence[str] | None = None,
) -> DataFrame:
    """One row per feature having current values.

    A feature without baseline is compared with itself and flagged ``baseline_missing``. Severity is that of
    the PSI, raised from ok to warn by a significant KS test; Z and KL are reported only.

    The values are shuffled once, as counts per distinct value; profile, cuts and bins all read that shuffle.
    """
    counted = tally(of_features(samples, features))

    def side_profile(side: str) -> list[Column]:
        present = f"FILTER (WHERE {side} > 0)"
        return [
            F.expr(f"sum({side})").alias(f"n_{side}"),
            F.expr(f"min(value) {present}").alias(f"low_{side}"),
            F.expr(f"max(value) {present}").alias(f"high_{side}"),
            F.expr(f"try_divide(sum(value * {side}), sum({side}))").alias(f"mean_{side}"),
        ]

    profile = counted.groupBy("feature_name").agg(
        *side_profile("base"), *side_profile("curr"), sketched_cuts("value").alias("cuts")
    )
    # Without baseline the current side stands in for it.
    constants = {
        "baseline_missing": "n_base = 0",
        **{f"{c}_base": f"if(n_base = 0, {c}_curr, {c}_base)" for c in ("n", "low", "high", "mean")},
        "n_curr": "n_curr",
        "mean_curr": "mean_curr",
        "joint_low": "least(low_base, low_curr)",
        "joint_high": "greatest(high_base, high_curr)",
    }
    profile = profile.filter("n_curr > 0").selectExpr(
        "feature_name", "cuts", *[f"{sql} AS {name}" for name, sql in constants.items()]
    )
    stands_in = "if(baseline_missing, curr, base)"
    ranged = with_range(counted.join(F.broadcast(checked(profile)), "feature_name")).withColumns(
        {
            "base": F.expr(stands_in),
            "psi_bin": psi_bin("value", "low_base", "high_base"),
            "kl_bin": kl_bin("value", "joint_low", "joint_high"),
            "squares": F.expr(f"{stands_in} * pow(value - mean_base, 2)"),
        }
    )
    # Bins ascend with the range, so a feature has at most (ranges + bins) of these groups.
    small = with_largest_gap(
        range_gaps(ranged, "psi_bin", "kl_bin", *constants, aggregates=[F.sum("squares").alias("squares")])
    )

    per_feature = small.groupBy("feature_name", *constants).agg(
        F.max("d").alias("d"),
        F.expr("sqrt(sum(squares) / n_base)").alias("std_base"),
        *[counts_per_bin(b, side).alias(f"{b}_{side}") for b in ("psi_bin", "kl_bin") for side in ("base", "curr")],
    )
    severity = psi_severity(F.col("psi_score"), thresholds.psi_warn, thresholds.psi_alert)
    kl = kl_score("kl_bin_base", "kl_bin_curr", "n_base", "n_curr", "joint_low", "joint_high")
    return (
        with_ks(per_feature, thresholds.ks_alpha, ks_method)
        .select(
            "feature_name",
            psi_score("psi_bin_base", "psi_bin_curr", "n_base", "n_curr", "low_base", "high_base").alias("psi_score"),
            "ks_statistic",
            "ks_p_value",
            "ks_significant",
            *z_columns("mean_base", "std_base", "mean_curr", "n_curr > 0", thresholds.z_alert),
            F.round(kl, 6).alias("kl_divergence"),
            F.col("n_base").alias("baseline_size"),
            F.col("n_curr").alias("current_size"),
            "baseline_missing",
        )
        .withColumn("severity", severity)
        .withColumn("severity", F.expr("if(severity = 'ok' AND ks_significant, 'warn', severity)"))
        .withColumn("is_drifting", F.col("severity") != "ok")
    )


def drift_verdict(report: DataFrame) -> DataFrame:
    """One row per run: critical if any feature alerts, and how many drift."""
    return report.agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if("is_drifting").alias("drifting"),
        (F.count_if(F.col("severity") == "alert") > 0).alias("has_critical_drift"),
    )
