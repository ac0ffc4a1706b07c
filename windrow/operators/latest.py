"""Latest row per user, seeded samples and user counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_user(rows: DataFrame, *order: str, key: str | tuple[str, ...] = "user_id") -> DataFrame:
    """The row with the greatest ``order`` of each user; later columns break ties of earlier ones.

    An aggregation and not a ranking: each task first keeps one row per user, so a user with many
    rows sends only a handful through the shuffle. The key stays a column of its own, through which filters on it
    reach the scan.
    """
    order = order or ("window_end", "computed_at")
    keys = [key] if isinstance(key, str) else list(key)
    others = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    newest = rows.groupBy(*keys).agg(F.max_by(others, F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*rows.columns)


def sample_order(key: str | Column, seed: str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_users(rows: DataFrame, n: int, seed: str = "0", key: str = "user_id") -> DataFrame:
    """``n`` distinct users without replacement, the same ones for the same seed.

    Every task keeps its best ``n``; only those meet in the final merge.
    """
    return rows.select(key).distinct().orderBy(sample_order(key, seed), key).limit(n)


def active_user_count(rows: DataFrame, approximate: bool = False, key: str = "user_id") -> DataFrame:
    count = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return rows.agg(count.alias("active_users"))


def in_cohort(rows: DataFrame, cohort: DataFrame | list[str] | None, key: str = "user_id") -> DataFrame:
    """Rows of the cohort. None or an empty list means no filter; a table of users is semi-joined."""
    if isinstance(cohort, DataFrame):
        return rows.join(cohort.select(key), key, "left_semi")
    return rows.filter(F.col(key).isin(cohort)) if cohort else rows
