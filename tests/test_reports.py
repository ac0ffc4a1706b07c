"""Consistency, serving, diagnosis and registry rules on small frames, and what plans must not contain."""

import json

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, queries
from windrow.operators import registry, serving
from windrow.operators.consistency import alerts, classify_skew, validate_consistency
from windrow.operators.diagnosis import diagnose, diagnosis_context
from windrow.schema import FEATURES

ONLINE = "user_id string, " + ", ".join(f"{c} double" for c in FEATURES)


def users(spark, *rows):
    """Rows of (user, base): the six features as fixed multiples of the base."""
    return spark.createDataFrame([(u, b, 10.0 * b, 0.3 * b, 0.2, 2.0 * b, 0.05) for u, b in rows], ONLINE)


def report(offline, online):
    return validate_consistency(offline, online).first()


@pytest.fixture(scope="module")
def hundred(spark):
    return [(f"usr_{i:05d}", float(i)) for i in range(1, 101)]


def test_identical_users_are_consistent(spark, hundred):
    row = report(users(spark, *hundred), users(spark, *hundred))
    assert (row["sample_size"], row["inconsistency_rate"], row["is_healthy"]) == (100, 0.0, True)


def test_all_or_half_inconsistent(spark, hundred):
    scaled = [(u, b * 1000) for u, b in hundred]
    assert report(users(spark, *hundred), users(spark, *scaled))["inconsistency_rate"] == 1.0
    half = hundred[:50] + [(u, b * 100) for u, b in hundred[50:]]
    row = report(users(spark, *hundred), users(spark, *half))
    assert (row["inconsistency_rate"], row["consistent_users"], row["is_healthy"]) == (0.5, 50, False)


def test_worst_feature_by_deviation_then_order(spark):
    offline, online = users(spark, ("u", 10.0)), users(spark, ("u", 10.0)).withColumn("avg_spend_1h", F.lit(10.0))
    row = report(offline.withColumn("avg_spend_1h", F.lit(1000.0)), online)
    assert (row["worst_feature"], row["max_deviation"]) == ("avg_spend_1h", 0.99)
    assert report(offline, offline)["worst_feature"] == FEATURES[0]


def test_missing_and_extra_users_and_the_threshold(spark):
    offline = users(spark, ("gone", 1.0), ("edge", 1.0))
    online = users(spark, ("extra", 1.0), ("edge", 1.0)).withColumn("avg_spend_1h", F.lit(10.0999))
    row = report(offline, online)
    assert (row["sample_size"], row["inconsistent_users"]) == (2, 1)
    assert row["dev_cart_abandon_ratio"] == pytest.approx(0.5, abs=1e-5)


def test_nothing_to_compare(spark):
    row = report(users(spark), users(spark))
    assert (row["sample_size"], row["inconsistency_rate"], row["worst_feature"], row["is_healthy"]) == (0, 0.0, FEATURES[0], True)
    assert alerts(validate_consistency(users(spark), users(spark)), F.lit(1.0)).isEmpty()
    assert classify_skew(validate_consistency(users(spark), users(spark))).first()["severity"] == "none"


# Serving --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def online(spark):
    rows = users(spark, ("a", 1.0), ("b", 2.0), ("c", 3.0))
    at = F.when(F.col("user_id") == "a", 940.0).when(F.col("user_id") == "b", 700.0).otherwise(100.0)
    return rows.withColumn("computed_at", at).withColumn("expires_at", at + 300.0)


def test_serving(spark, online):
    asked = spark.createDataFrame([("a",), ("c",), ("nobody",)], "user_id string")
    answer = {r["user_id"]: r for r in serving.serve_features(online, asked, 999.96).collect()}
    assert [answer[u]["found"] for u in ("a", "c", "nobody")] == [True, False, False]
    assert (answer["a"]["avg_spend_1h"], answer["a"]["freshness_seconds"]) == (10.0, 60.0)
    assert answer["nobody"]["avg_spend_1h"] == 0.0 and answer["nobody"]["computed_at"] is None
    bare = serving.serve_features(online, asked, 999.96, ["txn_count_5m", "no_such"], include_metadata=False)
    row = bare.filter("user_id = 'a'").first()
    assert (row["txn_count_5m"], row["avg_spend_1h"], row["computed_at"], row["source"]) == (1.0, 0.0, None, "online_store")


def test_freshness(spark, online):
    ages = serving.freshness(online, 1000)
    row = serving.freshness_report(ages).first()
    assert tuple(row) == (3, 300.0, pytest.approx(840.0), 1, 33.3)
    assert [r["user_id"] for r in serving.stalest(ages, 2).collect()] == ["c", "b"]
    empty = serving.freshness_report(ages.limit(0)).first()
    assert (empty["users"], empty["median_age"], empty["violations"]) == (0, None, 0)


def test_sla_per_feature(spark, online):
    found = serving.sla_violations(online, registry.seed_definitions(spark), 1010)
    assert {(r["freshness_sla_seconds"], r["users"], r["violations"]) for r in found.collect()} == {(60, 3, 3), (300, 3, 2)}
    assert found.count() == 6


def test_stale_users_are_alive_and_near_expiry(spark, online):
    ttl = {1000 - 60: [], 1000 - 59: ["b"], 1000 - 1: ["b"], 1000: []}
    for now, expected in ttl.items():
        assert [r["user_id"] for r in serving.find_stale(online, now).collect()] == expected


def test_latency(spark):
    rows = spark.createDataFrame([(200, 10.0), (404, 60.0), (200, 20.0), (500, 5000.0)], "status int, latency_ms double")
    row = serving.latency_report(rows).first()
    assert (row["requests"], row["p50_ms"], row["errors"], row["above_sla"], row["above_sla_pct"]) == (4, 20.0, 1, 1, 25.0)
    assert serving.latency_report(rows, approximate=True).first()["errors"] == 1
    assert serving.latency_report(rows.limit(0)).first()["p99_ms"] is None


def test_recent_diagnoses(spark):
    rows = spark.range(15).select(
        F.format_string("f%02d", "id").alias("feature_name"), F.lit("p").alias("probable_cause"), F.lit("c").alias("cause_category"),
        F.lit(0.5).alias("confidence"), F.lit("low").alias("urgency"), F.lit("x").alias("model_used"),
        F.timestamp_seconds("id").alias("computed_at"),
    )
    newest = serving.recent_diagnoses(rows)
    assert [r["feature_name"] for r in newest.collect()] == [f"f{i:02d}" for i in range(14, 4, -1)]
    assert len(newest.columns) == 6


# Diagnosis ------------------------------------------------------------------------------------------------


def drift_rows(spark, *rows):
    return spark.createDataFrame(rows, "feature_name string, psi_score double, ks_p_value double, z_score double")


def test_rules_in_order(spark):
    cases = [
        ("high", 0.30, 0.02, 4.0, "data_pipeline_delay", "high", 0.72, 4),
        ("negative", 0.30, 0.02, -4.0, "data_pipeline_delay", "high", 0.72, 4),
        ("limit", 0.20, 0.02, 4.0, "upstream_data_quality", "medium", 0.55, 4),
        ("moderate", 0.15, 0.50, 1.0, "upstream_data_quality", "medium", 0.55, 4),
        ("seasonal", 0.05, 0.03, 1.0, "seasonal_pattern", "low", 0.45, 3),
        ("unknown", 0.05, 0.50, 1.0, "unknown", "low", 0.30, 2),
    ]
    found = {r["feature_name"]: r for r in diagnose(drift_rows(spark, *[c[:4] for c in cases])).collect()}
    for name, *_, category, urgency, confidence, steps in cases:
        row = found[name]
        assert (row["cause_category"], row["urgency"], row["confidence"]) == (category, urgency, confidence)
        assert len(row["remediation_steps"]) == steps and row["affected_features"] == [name]
        assert row["fallback_used"] and row["model_used"] == "rule_based_fallback" and name in row["probable_cause"]
    assert "PSI=0.300, Z=4.00" in found["negative"]["probable_cause"]


def test_context_document(spark):
    rows = spark.createDataFrame(
        [("avg_spend_1h", 0.25, 0.15, 0.02, 3.8, 0.4, "alert", "last_7d", "last_1h", 500, 0.5)],
        "feature_name string, psi_score double, ks_statistic double, ks_p_value double, z_score double, kl_divergence double,"
        "severity string, baseline_period string, current_period string, sample_size int, computed_at double",
    )
    context = json.loads(diagnosis_context(rows, registry.seed_definitions(spark)).first()["context"])
    assert context["drift_metrics"]["psi_interpretation"].startswith("major shift")
    assert context["drift_metrics"]["ks_significant"] and context["drift_metrics"]["z_score_anomalous"]
    assert context["time_context"]["analysis_timestamp"] == "1970-01-01T00:00:00Z"
    assert context["feature_metadata"]["window_type"] == "sliding_1h"
    assert "feature_metadata" not in json.loads(diagnosis_context(rows).first()["context"])


# Registry -------------------------------------------------------------------------------------------------


def test_registry(spark):
    definitions, lineage = registry.seed_definitions(spark), registry.seed_lineage(spark)
    assert (definitions.count(), lineage.count()) == (6, 12)
    inactive = definitions.withColumn("is_active", F.col("feature_name") != "anomaly_score")
    listed = registry.list_features(inactive, lineage).collect()
    assert [r["feature_name"] for r in listed] == sorted(set(FEATURES) - {"anomaly_score"})
    assert [s["step"] for s in listed[0]["lineage"]] == [1, 2]
    assert registry.get_feature(inactive, lineage, "anomaly_score").count() == 1
    assert registry.get_feature(inactive, lineage, "no_such").isEmpty()
    assert registry.get_feature(definitions, lineage.limit(0), "avg_spend_1h").first()["lineage"] == []
    assert registry.missing_seeds(definitions.limit(4), definitions).count() == 2
    assert registry.missing_seeds(definitions, definitions).isEmpty()


# Plans ----------------------------------------------------------------------------------------------------

def test_entry(spark):
    assert entry(spark).count() > 0


def test_vector_shuffles_events_once_and_pushes_the_range_down(spark, small):
    plan = queries()["backfill_vector"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert "Expand" not in plan
