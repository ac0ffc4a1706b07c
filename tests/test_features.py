"""Window edges and null rules of the features, against values worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from windrow.operators import features
from windrow.operators.asof import point_in_time
from windrow.operators.latest import in_cohort, latest_per_user, sample_users
from windrow.operators.vector import Widths, backfill_vector, feature_vector

T0 = datetime(2024, 1, 1, 12)
SCHEMA = "event_id string, user_id string, session_id string, event_type string, timestamp timestamp_ntz, transaction_amount double"


def events(spark, *rows):
    """Rows of (user, minutes after noon, type, amount, session)."""
    full = [
        (str(i), user, session, kind, T0 + timedelta(minutes=minutes), amount)
        for i, (user, minutes, kind, amount, session) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def one(frame, **where):
    for column, value in where.items():
        frame = frame.filter(F.col(column) == value)
    rows = frame.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_event_on_a_boundary_belongs_to_the_later_window(spark):
    found = features.txn_count(events(spark, ("u", 5, "purchase", 1.0, "s"))).collect()
    assert [r["window_start"] for r in found] == [T0 + timedelta(minutes=5)]


def test_sliding_average_covers_every_window_over_a_purchase(spark):
    rows = events(spark, ("u", 0, "purchase", 10.0, "s"), ("u", 7, "purchase", 30.0, "s"), ("u", 8, "page_view", 0.0, "s"))
    found = {r["window_start"]: r["avg_spend_1h"] for r in features.avg_spend(rows).collect()}
    assert len(found) == 13
    assert found[T0 - timedelta(minutes=55)] == 10.0
    assert found[T0 - timedelta(minutes=50)] == 20.0
    assert found[T0 + timedelta(minutes=5)] == 30.0


def test_sliding_width_must_be_whole_slides(spark):
    with pytest.raises(ValueError):
        features.avg_spend(events(spark), "1 hour", "7 minutes")


def test_session_rate_ignores_missing_sessions(spark):
    rows = events(
        spark, ("u", 0, "search", 0.0, "a"), ("u", 1, "search", 0.0, "a"), ("u", 2, "search", 0.0, None), ("v", 0, "search", 0.0, None)
    )
    rates = {r["user_id"]: r["session_activity_rate"] for r in features.session_activity_rate(rows).collect()}
    assert rates == {"u": 3.0, "v": 0.0}


def test_cart_ratio_is_bounded_below_and_zero_without_carts(spark):
    rows = events(
        spark,
        ("more_buys", 0, "add_to_cart", 0.0, "s"), ("more_buys", 1, "purchase", 1.0, "s"), ("more_buys", 2, "purchase", 1.0, "s"),
        ("only_carts", 0, "add_to_cart", 0.0, "s"),
        ("no_carts", 0, "purchase", 1.0, "s"),
        ("half", 0, "add_to_cart", 0.0, "s"), ("half", 1, "add_to_cart", 0.0, "s"), ("half", 2, "purchase", 1.0, "s"),
    )
    ratios = {r["user_id"]: r["cart_abandon_ratio"] for r in features.cart_abandon_ratio(rows).collect()}
    assert ratios == {"more_buys": 0.0, "only_carts": 1.0, "no_carts": 0.0, "half": 0.5}


def test_users_without_purchase_have_no_vector(spark):
    assert feature_vector(events(spark, ("u", 0, "page_view", 0.0, "s"))).isEmpty()


def test_vector_uses_only_windows_closed_at_its_end(spark):
    rows = events(
        spark,
        ("u", -10, "add_to_cart", 0.0, "s"),  # 11:30-12:00, closed when the purchase window ends
        ("u", -20, "page_view", 0.0, "s"),  # 11:00-12:00, closed
        ("u", 1, "add_to_cart", 0.0, "s"),  # 12:00-12:30, still open
        ("u", 1, "page_view", 0.0, "s"),
        ("u", 2, "purchase", 40.0, "s"),
        ("u", 9, "purchase", 4000.0, "s"),
    )
    first = one(feature_vector(rows), window_start=T0)
    assert first["cart_abandon_ratio"] == 1.0
    assert first["product_interaction_freq"] == 1.0
    assert first["avg_spend_1h"] == 40.0
    assert first["session_activity_rate"] == 3.0
    assert first["anomaly_score"] == 0.0


def test_tumbling_window_closes_with_its_last_cell(spark):
    rows = events(spark, ("u", 1, "add_to_cart", 0.0, "s"), ("u", 27, "add_to_cart", 0.0, "t"), ("u", 28, "purchase", 5.0, "s"))
    assert one(feature_vector(rows))["cart_abandon_ratio"] == 0.5


def test_anomaly_score_by_hand(spark):
    rows = events(spark, ("u", -600, "purchase", 10.0, "s"), ("u", -300, "purchase", 20.0, "s"), ("u", 0, "purchase", 60.0, "s"))
    score = one(features.anomaly_score(rows), window_start=T0)["anomaly_score"]
    mean, deviation = 30.0, (((20**2 + 10**2 + 30**2) / 2) ** 0.5)
    assert score == pytest.approx(abs(60 - mean) / (deviation + 1e-6), rel=1e-12)


def test_anomaly_score_of_large_close_amounts(spark):
    amounts = [1e7, 1e7 + 0.01, 1e7 + 0.03]
    rows = events(spark, *[("u", -60 * i, "purchase", a, "s") for i, a in enumerate(amounts)])
    mean = 0.04 / 3
    deviation = ((mean**2 + (0.01 - mean) ** 2 + (0.03 - mean) ** 2) / 2) ** 0.5
    score = one(features.anomaly_score(rows), window_start=T0)["anomaly_score"]
    assert score == pytest.approx(mean / (deviation + 1e-6), rel=1e-5)


def test_history_reaches_across_time_blocks(spark):
    # One purchase every six hours over forty days: every vector but the first few sees four of them.
    rows = events(spark, *[("u", 360 * i, "purchase", float(i), "s") for i in range(160)])
    found = feature_vector(rows).orderBy("window_start").collect()
    assert len(found) == 160
    for i, row in enumerate(found):
        inside = [float(j) for j in range(max(0, i - 3), i + 1)]
        mean = sum(inside) / len(inside)
        if len(inside) > 1:
            deviation = (sum((x - mean) ** 2 for x in inside) / (len(inside) - 1)) ** 0.5
            assert row["anomaly_score"] == pytest.approx((i - mean) / (deviation + 1e-6), rel=1e-9)


def test_purchases_without_amount_count_but_do_not_average(spark):
    row = one(feature_vector(events(spark, ("u", 0, "purchase", None, "s"))))
    assert (row["txn_count_5m"], row["avg_spend_1h"], row["anomaly_score"]) == (1.0, 0.0, 0.0)


def test_widths_must_be_multiples_of_the_base():
    with pytest.raises(ValueError):
        Widths(base="7 minutes")


def test_backfill_has_history_and_excludes_earlier_windows(spark):
    rows = events(spark, ("u", -100, "purchase", 10.0, "s"), ("u", 1, "purchase", 30.0, "s"), ("u", 400, "purchase", 9.0, "s"))
    row = one(backfill_vector(rows, T0, T0 + timedelta(hours=2)))
    assert row["window_start"] == T0
    assert row["anomaly_score"] == pytest.approx(10 / (200**0.5 + 1e-6))


def test_latest_breaks_ties_by_computation_time(spark):
    rows = spark.createDataFrame(
        [("u", T0, 1.0, "old"), ("u", T0, 2.0, "new"), ("u", T0 - timedelta(hours=1), 9.0, "earlier")],
        "user_id string, window_end timestamp_ntz, computed_at double, note string",
    )
    assert one(latest_per_user(rows))["note"] == "new"


def test_samples_are_distinct_and_repeatable(spark):
    users = spark.range(1000).select(F.concat(F.lit("u"), F.col("id") % 300).alias("user_id"))
    first = [r[0] for r in sample_users(users, 50, "a").collect()]
    assert len(set(first)) == 50
    assert first == [r[0] for r in sample_users(users.repartition(5), 50, "a").collect()]
    assert set(first) != {r[0] for r in sample_users(users, 50, "b").collect()}


def test_empty_cohort_means_no_filter(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    assert in_cohort(users, None).count() == in_cohort(users, []).count() == 2
    assert in_cohort(users, ["a"]).count() == in_cohort(users, users.limit(1)).count() == 1


def test_point_in_time_against_brute_force(spark):
    minutes = [0, 5, 35, 60 * 24 * 3, 60 * 24 * 20]
    vectors = [(u, T0 + timedelta(minutes=m), float(m)) for u in ("a", "b") for m in minutes if (u, m) != ("b", 0)]
    labels = [
        (u, T0 + timedelta(seconds=s)) for u in ("a", "b", "none") for s in (-1, 0, 299, 300, 2100, 2101, 86400 * 9, 86400 * 40)
    ] * 2
    left = spark.createDataFrame(labels, "user_id string, label_ts timestamp_ntz")
    right = spark.createDataFrame(vectors, "user_id string, window_end timestamp_ntz, value double")

    def expected(limit):
        for user, at in labels:
            known = [(end, v) for u, end, v in vectors if u == user and end <= at and (limit is None or at - end <= limit)]
            yield (user, at, max(known)[1] if known else None)

    for text, limit in ((None, None), ("2 days", timedelta(days=2))):
        found = point_in_time(left, right, max_age=text).collect()
        ours = sorted(((r["user_id"], r["label_ts"], r["value"]) for r in found), key=repr)
        assert ours == sorted(expected(limit), key=repr)
