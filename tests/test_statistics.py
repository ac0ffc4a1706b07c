"""PSI, KS, Z, KL, quantiles and drift against NumPy on seeded draws, and the edge rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.functions.columns import psi_severity, skew_severity
from windrow.functions.kolmogorov import p_value
from windrow.operators import ranks
from windrow.operators.distribution import box_stats, feature_summary, histogram, kl_divergence, ks_2samp, psi, z_score
from windrow.operators.drift import detect_drift, drift_verdict

SCHEMA = "feature_name string, side string, value double"


def frame(spark, cases):
    rows = [
        (name, side, float(v))
        for name, (baseline, current) in cases.items()
        for side, values in (("baseline", baseline), ("current", current))
        for v in values
    ]
    return spark.createDataFrame(rows, SCHEMA)


def numpy_psi(a, b):
    edges = np.linspace(a.min(), a.max(), 11)
    edges[-1] += 1e-6
    p, q = (np.histogram(x, edges)[0] / (len(x) + 1e-6) for x in (a, b))
    p, q = np.where(p == 0, 1e-6, p), np.where(q == 0, 1e-6, q)
    return round(max(0.0, float(((q - p) * np.log(q / p)).sum())), 6)


def numpy_kl(a, b):
    edges = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()) + 1e-9, 11)
    p, q = (np.histogram(x, edges, density=True)[0] + 1e-10 for x in (a, b))
    p, q = p / p.sum(), q / q.sum()
    return float((p * np.log(p / q)).sum())


def numpy_d(a, b):
    at = np.unique(np.r_[a, b])
    f, g = (np.searchsorted(np.sort(x), at, "right") / len(x) for x in (a, b))
    return float(np.abs(f - g).max())


@pytest.fixture(scope="module")
def drawn():
    r = np.random.default_rng(42)
    same = r.normal(50, 10, 500)
    return {
        "txn_count_5m": (same, same),
        "avg_spend_1h": (r.lognormal(3.7, 1.2, 3000), r.lognormal(3.9, 1.2, 2000)),
        "session_activity_rate": (r.normal(50, 5, 1000), r.normal(100, 5, 1000)),
        "cart_abandon_ratio": (r.poisson(3, 1000), r.poisson(4, 800)),
        "product_interaction_freq": (r.normal(50, 10, 1000), r.normal(57, 10, 1000)),
        "anomaly_score": (np.repeat([1.0, 2.0], 100), np.repeat([1.0, 2.0], [150, 50])),
    }


@pytest.fixture(scope="module")
def samples(spark, drawn):
    return frame(spark, drawn).cache()


def by_feature(result):
    return {r["feature_name"]: r for r in result.collect()}


def test_each_statistic_equals_numpy(samples, drawn):
    psis, kls, ks, zs, report = map(
        by_feature, (psi(samples), kl_divergence(samples), ks_2samp(samples), z_score(samples), detect_drift(samples))
    )
    assert set(report) == set(drawn)
    for name, (a, b) in drawn.items():
        a, b = np.asarray(a, float), np.asarray(b, float)
        z = abs(b.mean() - a.mean()) / (a.std() + 1e-6)
        assert psis[name]["psi_score"] == report[name]["psi_score"] == pytest.approx(numpy_psi(a, b), abs=2e-6)
        assert kls[name]["kl_divergence"] == pytest.approx(numpy_kl(a, b), rel=1e-9, abs=1e-12)
        assert report[name]["kl_divergence"] == pytest.approx(numpy_kl(a, b), abs=1e-6)
        assert ks[name]["ks_statistic"] == report[name]["ks_statistic"] == pytest.approx(numpy_d(a, b), abs=1e-6)
        assert zs[name]["z_score"] == report[name]["z_score"] == pytest.approx(z, abs=1e-4)
        assert (report[name]["baseline_size"], report[name]["current_size"]) == (len(a), len(b))


def test_drift_severity(samples):
    report = by_feature(detect_drift(samples))
    assert report["txn_count_5m"]["severity"] == "ok"
    assert report["session_activity_rate"]["severity"] == "alert"
    assert report["session_activity_rate"]["is_anomalous"]
    verdict = drift_verdict(detect_drift(samples)).first()
    assert verdict["has_critical_drift"] and verdict["features"] == 6


def test_significant_ks_raises_ok_to_warn_and_nothing_else(spark):
    r = np.random.default_rng(3)
    a = r.normal(0, 1, 4000)
    report = by_feature(detect_drift(frame(spark, {"avg_spend_1h": (a, a + 0.09), "txn_count_5m": ([1.0, 1.0], [9.0, 9.0])})))
    assert report["avg_spend_1h"]["psi_score"] < 0.1 and report["avg_spend_1h"]["severity"] == "warn"
    # A constant baseline has no PSI; a huge Z alone changes nothing.
    constant = report["txn_count_5m"]
    assert constant["psi_score"] == 0.0 and constant["is_anomalous"] and constant["severity"] == "ok"


def test_feature_without_baseline_is_compared_with_itself(spark):
    cases = {"avg_spend_1h": ([], [1.0, 2.0, 3.0]), "txn_count_5m": ([1.0, 2.0], [])}
    report = by_feature(detect_drift(frame(spark, cases)))
    assert set(report) == {"avg_spend_1h"}
    row = report["avg_spend_1h"]
    assert row["baseline_missing"] and row["severity"] == "ok"
    assert (row["psi_score"], row["ks_statistic"], row["ks_p_value"], row["z_score"]) == (0.0, 0.0, 1.0, 0.0)


def test_empty_sides(spark):
    one_sided = frame(spark, {"avg_spend_1h": ([1.0, 2.0], []), "txn_count_5m": ([], [1.0, 2.0])})
    assert all(r["psi_score"] == 0.0 for r in psi(one_sided).collect())
    assert all(r["kl_divergence"] == 0.0 for r in kl_divergence(one_sided).collect())
    assert all((r["ks_statistic"], r["ks_p_value"], r["ks_significant"]) == (0.0, 1.0, False) for r in ks_2samp(one_sided).collect())
    row = z_score(one_sided).first()
    assert (row["current_mean"], row["baseline_mean"], row["baseline_std"], row["z_score"]) == (0.0, 0.0, 1.0, 0.0)
    assert psi(frame(spark, {})).isEmpty()


def test_values_outside_the_baseline_leave_the_bins_but_not_the_total(spark):
    a = np.arange(0.0, 11.0)
    b = np.r_[a, [100.0] * 11]
    found = psi(frame(spark, {"avg_spend_1h": (a, b)})).first()["psi_score"]
    assert found == pytest.approx(numpy_psi(a, b), abs=1e-6)


def test_baseline_maximum_is_in_the_last_bin(spark):
    counts = histogram(frame(spark, {"avg_spend_1h": ([0.0, 10.0], [])}).drop("side"), 10).orderBy("bin").collect()
    assert [r["n"] for r in counts] == [1] + [0] * 8 + [1]


def test_histogram_of_a_constant(spark):
    counts = histogram(frame(spark, {"avg_spend_1h": ([5.0, 5.0], [])}).drop("side"), 4).orderBy("bin").collect()
    assert sum(r["n"] for r in counts) == 2 and (counts[0]["lower"], counts[-1]["upper"]) == (4.5, 5.5)


def exact(spark, *cases):
    rows = spark.createDataFrame([(i, n, m, float(d)) for i, (n, m, d) in enumerate(cases)], "i int, n int, m int, d double")
    return [r[0] for r in rows.orderBy("i").select(p_value("n", "m", "d", "exact")).collect()]


def test_exact_p_values(spark):
    assert exact(spark, (5, 5, 1.0), (3, 4, 1.0), (7, 9, 0.0)) == pytest.approx([2 / 252, 2 / 35, 1.0])
    assert exact(spark, (0, 3, 0.5)) == [None]


def test_exact_p_counts_lattice_paths(spark):
    from itertools import combinations

    n, m = 4, 6
    gaps = []
    for ups in combinations(range(n + m), n):
        i = j = 0
        worst = 0.0
        for step in range(n + m):
            i, j = (i + 1, j) if step in ups else (i, j + 1)
            worst = max(worst, abs(i / n - j / m))
        gaps.append(worst)
    limits = (0.25, 1 / 3, 0.5, 0.75)
    want = [sum(g >= d - 1e-12 for g in gaps) / len(gaps) for d in limits]
    assert exact(spark, *[(n, m, d) for d in limits]) == pytest.approx(want)


def test_asymptotic_p_is_close_to_exact(spark):
    cases = [(200, 200, 0.1), (500, 400, 0.05)]
    frame = spark.createDataFrame(cases, "n int, m int, d double")
    series = [r[0] for r in frame.select(p_value("n", "m", "d")).collect()]
    assert series == pytest.approx(exact(spark, *cases), abs=0.03)
    with pytest.raises(ValueError, match="unknown method"):
        p_value("n", "m", "d", "auto")


def test_too_many_groups_for_a_broadcast_fail(spark):
    groups = spark.range(30).selectExpr("CAST(id AS STRING) AS feature_name", "id")
    assert ranks.checked(groups, 30).count() == 30
    with pytest.raises(Exception, match="more than 29 groups"):
        ranks.checked(groups, 29).collect()


def test_features_beyond_the_six_are_compared(spark):
    rows = [("seventh", side, float(i + (side == "current") * 50)) for i in range(100) for side in ("baseline", "current")]
    samples = spark.createDataFrame(rows, "feature_name string, side string, value double")
    assert [r.feature_name for r in detect_drift(samples).collect()] == ["seventh"]
    assert feature_summary(samples.drop("side")).count() == 1
    assert detect_drift(samples, features=["sixth"]).isEmpty()


def test_severity_thresholds(spark):
    rows = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.15, 0.2, 0.25)], "v double")
    assert [r[0] for r in rows.select(psi_severity(F.col("v"))).collect()] == ["ok", "warn", "warn", "alert", "alert"]
    rates = spark.createDataFrame([(x,) for x in (0.0, 0.01, 0.02, 0.03, 0.05, 0.06, 0.1, 0.11)], "v double")
    assert [r[0] for r in rates.select(skew_severity(F.col("v"))).collect()] == [
        "none", "low", "low", "medium", "medium", "high", "high", "critical",
    ]


def test_quantiles_equal_numpy_over_many_ranges(spark):
    """More distinct values than the cut sample holds, a value with a third of the rows, two groups."""
    r = np.random.default_rng(5)
    heavy = np.r_[r.lognormal(3, 2, 40_000), np.full(20_000, 7.0)]
    few = np.array([1.0, 2.0, 4.0])
    rows = spark.createDataFrame([("a", float(v)) for v in heavy] + [("b", float(v)) for v in few], "feature_name string, value double")
    wanted = [0.0, 0.1, 0.25, 0.5, 0.95, 0.999, 1.0]
    found = {(x["feature_name"], x["p"]): x["quantile"] for x in ranks.quantiles(rows, wanted).collect()}
    for name, values in (("a", heavy), ("b", few)):
        for p in wanted:
            assert found[name, p] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12)
    approximate = {(x["feature_name"], x["p"]): x["quantile"] for x in ranks.approximate_quantiles(rows, [0.5]).collect()}
    assert approximate["a", 0.5] == pytest.approx(np.percentile(heavy, 50), rel=0.01)


def test_ks_over_many_ranges_equals_numpy(spark):
    r = np.random.default_rng(6)
    a, b = np.r_[r.normal(0, 1, 30_000), np.zeros(10_000)], r.normal(0.02, 1, 30_000)
    found = ks_2samp(frame(spark, {"avg_spend_1h": (a, b)})).first()
    assert found["ks_statistic"] == pytest.approx(numpy_d(a, b), abs=1e-6)


def test_value_ranges_are_of_even_size(spark):
    r = np.random.default_rng(7)
    values = np.unique(r.lognormal(0, 5, 50_000))
    counted = spark.createDataFrame([("a", float(v)) for v in values], "feature_name string, value double")
    cuts = ranks.value_cuts(counted)
    sizes = ranks.with_range(counted.join(cuts, "feature_name")).groupBy("range_id").count().toPandas()["count"]
    assert 700 < len(sizes) < 1400 and sizes.max() < 10 * sizes.mean()


def test_summary_and_box(spark):
    values = [1.0, 2.0, 3.0, 10.0]
    rows = frame(spark, {"avg_spend_1h": (values, [])}).drop("side")
    for approximate in (False, True):
        row = feature_summary(rows, approximate=approximate).first()
        assert (row["n"], row["mean"], row["std"], row["max"]) == (4, 4.0, round(float(np.std(values)), 3), 10.0)
    assert feature_summary(rows).first()["p95"] == round(float(np.percentile(values, 95)), 3)
    box = box_stats(rows).first()
    assert (box["min"], box["q1"], box["median"], box["q3"], box["max"]) == (1.0, 1.75, 2.5, 4.75, 10.0)
