"""Exact ranks over any number of values, without ever sorting a group in one task.

Few groups (six features, or a single one) with unbounded values cannot be partitioned by group. Values
are counted first, which removes repeats on the map side, and then split into value ranges of about equal
numbers of distinct values. Ranges are cut at a sample chosen by hash, so the cuts depend on the data
alone and a recomputed task sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of what is broadcast per group: cuts are every _STRIDE-th of about _SAMPLE values. The search for
# a value's range quarters the cuts at each step, and finds up to 4 ** _SEARCH_STEPS - 1 of them.
_SAMPLE = 16_384
_STRIDE = 16
_SEARCH_STEPS = 6


# Most groups whose rows are broadcast; with a thousand cuts each these are some ten megabytes.
MOST_GROUPS = 1000


def checked(per_group: DataFrame, most: int = MOST_GROUPS) -> DataFrame:
    """A frame of a row per group, for a broadcast; the job fails if there are more than ``most`` of them.

    The rows are counted as part of the plan. More groups than that are to be given some at a time.
    """
    first = per_group.columns[0]
    many = F.count(F.lit(1)).over(Window.partitionBy()) > most
    message = F.lit(f"more than {most} groups; name fewer of them at a time")
    return per_group.withColumn(first, F.when(many, F.raise_error(message).cast(per_group.schema[first].dataType)).otherwise(F.col(first)))


def value_cuts(counted: DataFrame, group: str = "feature_name", value: str = "value") -> DataFrame:
    """Per group an ascending array of about a thousand ``cuts``. ``counted`` has one row per distinct value.

    The cuts are chosen by hash, one value in ``n / 16384`` of ``n``, and so are a function of the data.
    """
    size = counted.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    keep_one_in = F.greatest(F.lit(1), F.ceil(F.col("_n") / _SAMPLE))
    sampled = (
        counted.join(F.broadcast(checked(size)), group)
        .filter(F.pmod(F.xxhash64(value), keep_one_in) == 0)
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(value)).alias("_sample"))
    )
    every = F.filter("_sample", lambda _, i: i % _STRIDE == 0)
    return sampled.select(group, every.alias("cuts"))


def sketched_cuts(value: str) -> Column:
    """Aggregate: about a thousand cuts from a quantile sketch.

    Cheaper than ``value_cuts``, but a sketch depends on the order in which it is merged. It is for plans that
    read the cuts in one place and whose result is the same for any cuts.
    """
    # One text literal, as a thousand number literals would be visited by every optimizer rule.
    shares = ",".join(str(i / 1024) for i in range(1, 1024))
    return F.expr(f"percentile_approx({value}, CAST(split('{shares}', ',') AS ARRAY<DOUBLE>), 4096)")


def with_range(counted: DataFrame, value: str = "value") -> DataFrame:
    """Replaces ``cuts`` by ``range_id``, ascending with the value: the number of cuts at or below it.

    A search written as one projection per step. Steps compile into straight-line code over the broadcast
    array, where a lambda over the array would be interpreted and the array copied with each row.
    """
    found = counted.withColumn("range_id", F.lit(0))
    for step in (4**i for i in reversed(range(_SEARCH_STEPS))):
        passed = (f"if(get(cuts, range_id + {k * step - 1}) <= {value}, {step}, 0)" for k in (1, 2, 3))
        found = found.withColumn("range_id", F.expr(f"range_id + {' + '.join(passed)}"))
    return found.drop("cuts")


def quantiles(
    rows: DataFrame, probabilities: list[float], group: str = "feature_name", value: str = "value"
) -> DataFrame:
    """``(group, p, quantile)``: linear interpolation between neighbouring ranks, exact.

    The number of groups is bounded by the caller; the number of values is not. Only the value ranges
    holding a wanted rank are sorted.
    """
    counted = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    cuts = value_cuts(counted, group, value)
    ranged = with_range(counted.join(F.broadcast(checked(cuts)), group), value)

    ordered = Window.partitionBy(group).orderBy("range_id")
    totals = (
        ranged.groupBy(group, "range_id")
        .agg(F.sum("n").alias("_in_range"))
        .withColumns(
            {
                "_before": F.sum("_in_range").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in_range"),
                "_total": F.sum("_in_range").over(Window.partitionBy(group)),
            }
        )
    )

    def wanted(p: float) -> Column:
        position = F.lit(p) * (F.col("_total") - 1)
        ends = F.array_distinct(F.array(F.floor(position), F.ceil(position)))
        return F.transform(
            ends,
            lambda rank: F.struct(F.lit(p).alias("p"), rank.alias("rank"), (1.0 - F.abs(position - rank)).alias("weight")),
        )

    targets = totals.select(
        group, "range_id", "_before", "_in_range", F.inline(F.flatten(F.array(*[wanted(float(p)) for p in probabilities])))
    ).filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_in_range")))
    in_range = Window.partitionBy(group, "range_id", "p", "rank").orderBy(value)
    return (
        ranged.join(F.broadcast(targets), [group, "range_id"])
        .withColumn("_upto", F.col("_before") + F.sum("n").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("n")))
        .groupBy(group, "p")
        .agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.min_by("weight", "rank").alias("_low_weight"))
        .select(
            group,
            "p",
            (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.lit(1.0) - F.col("_low_weight"))).alias("quantile"),
        )
    )


def approximate_quantiles(
    rows: DataFrame, probabilities: list[float], group: str = "feature_name", value: str = "value"
) -> DataFrame:
    """Same shape from a sketch: one pass, error at most a ten-thousandth of the rank."""
    sketch = F.percentile_approx(value, probabilities, F.lit(10_000))
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probabilities]).alias("p"), F.col("q").alias("quantile"))
    return (
        rows.groupBy(group)
        .agg(sketch.alias("q"))
        .select(group, F.inline(F.transform(pairs, lambda x: F.struct(x["p"].alias("p"), x["quantile"].alias("quantile")))))
    )


def wide_quantiles(rows: DataFrame, names: dict[str, float], group: str, value: str, approximate: bool) -> DataFrame:
    """One row per group and one column per named probability."""
    find = approximate_quantiles if approximate else quantiles
    found = find(rows, sorted(set(names.values())), group, value)
    return found.groupBy(group).agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(name) for name, p in names.items()]
    )
