"""Two-sided two-sample Kolmogorov-Smirnov p-values from ``(n, m, D)``, one row per feature."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# A p that is surely below this is 0; sums of shares are not exact to more digits.
NEGLIGIBLE = 1e-12


def asymptotic_p(n: str, m: str, d: str) -> Column:
    """Kolmogorov's series at the argument corrected for finite samples (Vrbik, 2018).

    Below 0.2 the series is 1 to twelve digits but converges too slowly to be summed.
    """
    effective = f"round(double({n}) * {m} / ({n} + {m}))"
    z = f"(sqrt({effective}) * {d})"
    x = f"({z} + 1D / (6D * sqrt({effective})) + ({z} - 1D) / (4D * {effective}))"
    terms = f"transform(sequence(1, 100), k -> if(k % 2 = 1, 2D, -2D) * exp(-2D * k * k * {x} * {x}))"
    series = f"aggregate({terms}, 0D, (total, term) -> total + term)"
    return F.expr(f"CASE WHEN {d} <= 0 OR {x} < 0.2D THEN 1D ELSE least(greatest({series}, 0D), 1D) END")


def exact_p(n: str, m: str, d: str) -> Column:
    """The share of lattice paths from (0, 0) to (n, m) that reach a gap of ``d``.

    Walks the lattice by its diagonals, and on each only over the points inside the gap, as all others have none of the paths
    that stay below it: those with ``low <= i <= high`` of the steps to the right. ``inside`` holds, for each point, the share
    of paths to it that have kept below the gap; shares don't overflow. A row costs ``n + m`` array operations over
    2 d n m / (n + m) points.

    How many of the first steps go to the right is a count drawn without replacement, and by Serfling's inequality reaches
    the gap at one diagonal with a chance of at most ``2 exp(-2 reach^2 / ((n + m) (n m + min(n, m))))``. Where even the sum over
    all diagonals is below ``NEGLIGIBLE`` nothing is walked. So the points of a diagonal grow with the root of ``n + m`` only.
    """
    negligible = NEGLIGIBLE

    # A function of its own, so that it goes to the tasks whole.
    def outside(right: int, up: int, reach: int) -> float:
        both = right + up
        bound = math.log(2 * both) - 2 * reach * reach / (both * (right * up + min(right, up)))
        if bound < math.log(negligible):
            return 0.0
        inside, steps = np.zeros(right + 2), np.arange(right + 1, dtype=float)
        inside[1] = 1.0  # behind a zero, as the point before the first has no paths
        before = 0
        for length in range(1, both + 1):
            low = max(0, length - up, (length * right - reach) // both + 1)
            high = min(right, length, -((-length * right - reach) // both) - 1)
            if low > high:
                return 1.0
            stay = inside[low + 1 : high + 2]
            moved = inside[low : high + 1] - stay
            moved *= steps[low : high + 1]
            moved /= length
            stay += moved
            inside[before + 1 : low + 1] = 0.0
            before = low
        return min(max(1.0 - inside[right + 1], 0.0), 1.0)

    def walked(right: pd.Series, up: pd.Series, reach: pd.Series) -> pd.Series:
        rows = zip(right.tolist(), up.tolist(), reach.tolist(), strict=True)
        return pd.Series([outside(int(a), int(b), int(c)) if a > 0 and b > 0 and c > 0 else 1.0 for a, b, c in rows], dtype=float)

    reach = f"coalesce(bigint(round({d} * {n} * {m})), 0L)"
    share = F.pandas_udf(walked, "double")(F.expr(f"coalesce(bigint({n}), 0L)"), F.expr(f"coalesce(bigint({m}), 0L)"), F.expr(reach))
    return F.when(F.expr(f"{n} = 0 OR {m} = 0"), F.lit(None)).when(F.expr(f"{reach} <= 0"), 1.0).otherwise(share)


def p_value(n: str, m: str, d: str, method: str = "asymptotic") -> Column:
    """p from the named columns, by the ``asymptotic`` series or the ``exact`` count, whatever the samples' sizes."""
    if method == "asymptotic":
        return asymptotic_p(n, m, d)
    if method == "exact":
        return exact_p(n, m, d)
    raise ValueError(f"unknown method {method!r}")
