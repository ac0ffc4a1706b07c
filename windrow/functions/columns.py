"""Small column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smoothing constant in relative deviations and shares.
EPSILON = 1e-6


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, 0.0 where the denominator is null or not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0)).cast("double")


def relative_deviation(offline: Column, online: Column) -> Column:
    return F.abs(offline - online) / (F.abs(offline) + F.lit(EPSILON))


def psi_severity(psi: Column, warn: float = 0.1, alert: float = 0.2) -> Column:
    return F.when(psi < warn, "ok").when(psi < alert, "warn").otherwise("alert")


def psi_reading(psi: Column) -> Column:
    # The three readings of a PSI score.
    return (
        F.when(psi < 0.1, "no significant shift")
        .when(psi < 0.2, "moderate shift — monitor closely")
        .otherwise("major shift — investigate immediately")
    )


def skew_severity(rate: Column) -> Column:
    # Share of inconsistent users above which a level applies.
    return (
        F.when(rate > 0.10, "critical")
        .when(rate > 0.05, "high")
        .when(rate > 0.02, "medium")
        .when(rate > 0.0, "low")
        .otherwise("none")
    )


def bin_index(value: str, low: str, width: str, n_bins: int) -> str:
    """SQL for how many of the left edges ``low + i * width`` are at or below ``value`` (0 = below all).

    A sum of comparisons: it stays in generated code and reproduces the edges exactly, which
    a division by the width or ``width_bucket`` does not.
    """
    return " + ".join(f"CAST({value} >= {low} + {float(i)}D * ({width}) AS INT)" for i in range(n_bins))
