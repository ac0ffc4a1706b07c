"""Keyed state with expiry, mergeable summaries, levels, and the comparison of whole rows."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.functions.kolmogorov import p_value
from windrow.functions.time import epoch
from windrow.operators import rollups, sketches
from windrow.operators.distribution import ks_2samp
from windrow.operators.vector import backfill_vector
from windrow.plans import jobs
from windrow.schema import FEATURES
from windrow.sources.activity import read_activity
from windrow.sources.stores import FeatureHistory
from windrow.streaming.current import read_current, start_current

BEGIN = datetime(2024, 1, 1)
VECTOR = "user_id string, window_end timestamp, computed_at double, " + ", ".join(f"{c} double" for c in FEATURES)


def vector(user, minute, *values):
    at = BEGIN + timedelta(minutes=minute)
    return (user, at, at.timestamp(), *(values + (None,) * 6)[:6])


def arrive(spark, folder, number, rows):
    spark.createDataFrame(rows, VECTOR).coalesce(1).write.parquet(f"{folder}/part={number}")


def run(spark, folder, tmp_path, **options):
    stream = spark.readStream.schema(VECTOR).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    start_current(stream, f"{tmp_path}/changes", f"{tmp_path}/checkpoint", trigger=None, **options).awaitTermination()
    return {r.user_id: r for r in read_current(spark, f"{tmp_path}/checkpoint").collect()}


def test_state_expires_merges_and_survives_a_restart(spark, tmp_path):
    folder, hour = f"{tmp_path}/arriving", 3600.0
    arrive(spark, folder, 1, [vector("a", 5, 1.0, 2.0), vector("b", 5, 7.0), vector("c", 6, 1.0)])
    held = run(spark, folder, tmp_path, ttl=hour, watermark="1 minute")
    assert set(held) == {"a", "b", "c"}
    # A later row that leaves a feature out keeps it; an older window, sent again, changes nothing.
    arrive(spark, folder, 2, [vector("a", 30, None, 3.0), vector("a", 10, 9.0, 9.0, 9.0), vector("d", 40, 4.0)])
    held = run(spark, folder, tmp_path, ttl=hour, watermark="1 minute")
    assert set(held) == {"a", "b", "c", "d"}
    assert [held["a"][c] for c in FEATURES[:3]] == [9.0, 3.0, 9.0]
    assert held["a"].window_end == BEGIN + timedelta(minutes=30)
    # b and c are due an hour after theirs, a not yet: its timer went with its new window.
    arrive(spark, folder, 3, [vector("d", 68, 5.0)])
    held = run(spark, folder, tmp_path, ttl=hour, watermark="1 minute")
    assert set(held) == {"a", "d"} and held["d"][FEATURES[0]] == 5.0
    arrive(spark, folder, 4, [vector("b", 70, None, 1.0)])
    held = run(spark, folder, tmp_path, ttl=hour, watermark="1 minute")
    # What expired does not come back with a user's next row.
    assert held["b"][FEATURES[0]] is None and held["b"][FEATURES[1]] == 1.0
    changes = spark.read.parquet(f"{tmp_path}/changes").collect()
    expired = sorted((r.user_id, r.expires_at - BEGIN.timestamp()) for r in changes if r.change == "expired")
    assert expired == [("b", 65 * 60.0), ("c", 66 * 60.0)]


def test_state_by_the_clock_lives_for_its_ttl(spark, tmp_path):
    import time

    folder, checkpoint = f"{tmp_path}/arriving", f"{tmp_path}/checkpoint"
    arrive(spark, folder, 1, [vector("a", 5, 1.0)])
    stream = spark.readStream.schema(VECTOR).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    with pytest.raises(ValueError, match="no end"):
        start_current(stream, f"{tmp_path}/changes", checkpoint, by_clock=True, trigger=None)

    def until_read():
        query = start_current(stream, f"{tmp_path}/changes", checkpoint, ttl=5.0, by_clock=True, trigger="1 second")
        for _ in range(60):
            time.sleep(0.5)
            if any(p.numInputRows for p in query.recentProgress):
                break
        query.stop()
        return {r.user_id: r for r in read_current(spark, checkpoint).collect()}

    assert set(until_read()) <= {"a"}
    time.sleep(6)
    arrive(spark, folder, 2, [vector("a", 4, None, 2.0), vector("b", 6, 1.0)])
    until_read()
    # An older window counts again, as nothing is left of the later one.
    changes = spark.read.parquet(f"{tmp_path}/changes").collect()
    at = BEGIN.timestamp()
    assert sorted((r.user_id, r.change, r.window_end - at) for r in changes) == [("a", "set", 240.0), ("a", "set", 300.0), ("b", "set", 360.0)]


def long_values(spark, days, per_day):
    rows = spark.range(days * per_day).select(
        F.lit("f").alias("feature_name"),
        F.date_add(F.lit(BEGIN.date()), (F.col("id") % days).cast("int")).alias("day"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0).alias("value"),
    )
    return rows.unionByName(rows.limit(5).withColumn("value", F.lit(float("nan"))))


def test_merged_quantiles_are_close_and_read_no_rows(spark, tmp_path):
    rows = long_values(spark, 31, 8000)
    sketches.daily_values(rows, F.col("day")).write.parquet(f"{tmp_path}/daily")
    daily = spark.read.parquet(f"{tmp_path}/daily")
    assert daily.count() == 31
    merged = sketches.summary(daily)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "xxhash64" not in plan
    row = merged.first()
    kept = np.array([r.value for r in rows.filter(~F.isnan("value")).select("value").collect()])
    assert row.n == len(kept) and row["mean"] == pytest.approx(kept.mean())
    assert (row["min"], row["max"]) == (kept.min(), kept.max())
    for q in sketches.QUANTILES:
        value = row[sketches.quantile_name(q)]
        assert (kept < value).mean() - 0.005 <= q <= (kept <= value).mean() + 0.005
    some = sketches.summary(daily, "2024-01-03", "2024-01-05").first()
    assert some.n == 3 * 8000


def test_merged_users_are_close(spark):
    events = spark.range(200_000).select(
        F.pmod(F.xxhash64("id"), F.lit(60_000)).cast("string").alias("user_id"),
        F.date_add(F.lit(BEGIN.date()), (F.col("id") % 10).cast("int")).alias("day"),
    )
    daily = sketches.daily_users(events, F.col("day"))
    found = {r.day: r.users for r in sketches.active_users(daily, 4).collect()}
    assert len(found) == 10
    for day, users in found.items():
        exact = events.filter(F.col("day").between(day - timedelta(days=3), day)).select("user_id").distinct().count()
        assert abs(users - exact) <= 0.03 * exact


def full_walk(n, m, d):
    """Share of lattice paths that reach the gap, over all points, a row at a time."""
    reach, inside = round(d * n * m), None
    i = np.arange(n + 1)
    for length in range(n + m + 1):
        ok = (i <= length) & (length - i <= m) & (np.abs(i * m - (length - i) * n) < reach)
        if inside is None:
            inside = np.where(i == 0, 1.0, 0.0)
        else:
            before = np.append(0.0, inside[:-1])
            inside = np.where(ok, inside * ((length - i) / length) + before * (i / length), 0.0)
    return 1 - inside[n]


def test_exact_p_is_that_of_the_whole_lattice(spark):
    cases = [(5, 5, 1.0), (3, 4, 1.0), (1, 1, 1.0), (1, 9, 0.5), (40, 60, 0.2), (60, 40, 0.2), (200, 200, 0.1), (333, 150, 0.07), (7, 300, 0.31)]
    rows = spark.createDataFrame([(i, n, m, float(d)) for i, (n, m, d) in enumerate(cases)], "i int, n long, m long, d double")
    found = [r[0] for r in rows.orderBy("i").select(p_value("n", "m", "d", "exact")).collect()]
    assert found == pytest.approx([full_walk(*c) for c in cases], abs=1e-12)
    assert found[:2] == pytest.approx([2 / 252, 2 / 35])


def test_exact_p_of_large_samples(spark):
    """Ten thousand values on a side, near the series of infinite samples."""
    rows = spark.createDataFrame([(10_000, 10_000, 0.02), (9_000, 11_000, 0.025)], "n long, m long, d double")
    found = [r[0] for r in rows.select(p_value("n", "m", "d", "exact")).collect()]
    for (n, m, d), p in zip([(10_000, 10_000, 0.02), (9_000, 11_000, 0.025)], found, strict=True):
        x = d * math.sqrt(n * m / (n + m))
        series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 100))
        assert p == pytest.approx(series, rel=0.03)


def test_exact_p_of_a_million_values(spark):
    """Some ten billion steps of lattice: near the series where p matters, and nothing to walk where it is surely 0."""
    cases = [(500_000, 480_000, 0.002), (500_000, 480_000, 0.001), (3_000_000, 2_000_000, 0.14), (40, 4_000_000, 0.9)]
    rows = spark.createDataFrame(cases, "n long, m long, d double").coalesce(1)
    found = [r[0] for r in rows.select(p_value("n", "m", "d", "exact")).collect()]
    for (n, m, d), p in zip(cases[:2], found, strict=False):
        x = d * math.sqrt(n * m / (n + m))
        assert p == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 100)), rel=0.01)
    assert found[2:] == [0.0, 0.0]


def test_exact_ks_over_samples(spark):
    rows = [("f", side, float(i + (side == "current") * 30)) for i in range(300) for side in ("baseline", "current")]
    found = ks_2samp(spark.createDataFrame(rows, "feature_name string, side string, value double"), method="exact").first()
    assert found["ks_statistic"] == 0.1
    assert found["ks_p_value"] == pytest.approx(full_walk(300, 300, 0.1), abs=1e-6)


def test_levels_are_those_of_separate_queries(spark, small):
    events = read_activity(spark, small)
    segments = spark.createDataFrame([(f"usr_{i:05d}", "abc"[i % 3]) for i in range(10)], "user_id string, segment string")
    frame = rollups.activity_levels(events, segments)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1
    found = frame.collect()
    rows = events.join(segments, "user_id", "left").withColumn("day", F.to_date("timestamp"))
    keys = ["day", "event_type", "segment"]
    sets = {0: keys, 1: keys[:2], 2: ["day", "segment"], 3: ["day"], 5: ["event_type"], 6: ["segment"], 7: []}
    assert {r.level for r in found} == set(sets)
    for level, own in sets.items():
        counts = rows.groupBy(*own).agg(F.count("*").alias("n"), F.sum("transaction_amount").alias("revenue")).collect()
        want = {tuple(r[k] for k in own): (r.n, pytest.approx(r.revenue, abs=1e-4)) for r in counts}
        got = {tuple(r[k] for k in own): (r.events, r.revenue) for r in found if r.level == level}
        assert got == want
    # A null segment of its own is told from one that is left out.
    assert any(r.segment is None for r in found if r.level == 6)


def test_drift_levels(spark):
    rows = [("a", "baseline", 0.0), ("a", "current", 2.0), ("b", "current", None)]
    found = rollups.drift_levels(spark.createDataFrame(rows, "feature_name string, side string, value double"))
    got = {(r.feature_name, r.side, r.level): (r.n, r.zeros, r.zero_share) for r in found.collect()}
    assert got[(None, None, 3)] == (2, 1, 0.5)
    assert got[("a", None, 1)] == (2, 1, 0.5) and got[(None, "current", 2)] == (1, 0, 0.0)
    assert got[("b", "current", 0)] == (0, 0, None)


def test_a_wrong_row_is_named(spark, small, tmp_path):
    """A day with the right number of rows, one of them wrong, does not agree."""
    events = read_activity(spark, small)
    history = FeatureHistory(spark, f"{tmp_path}/h")
    start, end = datetime(2024, 1, 5), datetime(2024, 1, 9, 18)
    fresh = backfill_vector(events, start, end)
    victim = fresh.orderBy("window_start", "user_id").first()
    wrong = (F.col("user_id") == victim.user_id) & (epoch("window_start") == victim.window_start.timestamp())
    history.append(fresh.withColumn(FEATURES[1], F.when(wrong, F.col(FEATURES[1]) + 1).otherwise(F.col(FEATURES[1]))))
    found = {str(r.event_date): r for r in jobs.verify_backfill(history, events, start, end).collect()}
    day = str(victim.window_start.date())
    assert [(d, r.missing, r.unexpected) for d, r in found.items() if not r.agrees] == [(day, 1, 1)]
    assert found[day].stored == found[day].expected
    named = jobs.differing_vectors(history, events, start, end).collect()
    assert sorted(r.side for r in named) == ["missing", "unexpected"]
    assert {(r.user_id, r.window_start) for r in named} == {(victim.user_id, victim.window_start)}
