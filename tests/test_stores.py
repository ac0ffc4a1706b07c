"""Parsing and validation, append-only tables, the online store, baselines, logs and jobs."""

import json
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from windrow.operators.vector import backfill_vector, feature_vector
from windrow.plans import jobs
from windrow.schema import EVENT_SCHEMA, FEATURES
from windrow.sources.activity import read_activity, user_name
from windrow.sources.events import encode_events, parse_events, read_event_history, validate_events
from windrow.sources.stores import Baselines, FeatureHistory, OnlineStore, diagnosis_log, metric_log
from windrow.sources.tables import BatchTable, partition_filter, with_partition_columns

T0 = datetime(2024, 1, 1, 12)
VECTOR = (
    "user_id string, window_start timestamp, window_end timestamp, computed_at double, "
    + ", ".join(f"{c} double" for c in FEATURES)
)


def vectors(spark, *rows):
    """Rows of (user, minutes after noon, computed_at, value of every feature)."""
    full = [
        (user, T0 + timedelta(minutes=m), T0 + timedelta(minutes=m + 5), float(at), *[float(value)] * len(FEATURES))
        for user, m, at, value in rows
    ]
    return spark.createDataFrame(full, VECTOR)


def values(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


# Events ---------------------------------------------------------------------------------------------------


def record(spark, **changes):
    whole = {
        "event_id": "e1", "user_id": "usr_00001", "session_id": "ses_1", "event_type": "purchase", "timestamp": T0,
        "transaction_amount": 99.99, "product_id": "prod_00512", "category": "electronics",
        "location": ("US", "Austin"), "device_type": "mobile", "schema_version": "1.0",
    }
    return spark.createDataFrame([tuple({**whole, **changes}.values())], EVENT_SCHEMA)


def test_round_trip(spark):
    event = record(spark)
    message = encode_events(event)
    assert bytes(message.first()["key"]) == b"usr_00001"
    assert parse_events(message).collect() == event.collect()


def test_rows_that_are_no_event_are_dropped(spark):
    lines = ["not json", "", "{}", '{"user_id": null, "event_type": "purchase"}', '{"user_id": "u", "extra": 1}', "[1, 2]"]
    raw = spark.createDataFrame([(line.encode(),) for line in lines], "value binary")
    parsed = parse_events(raw).collect()
    assert [r["user_id"] for r in parsed] == ["u"]
    assert parsed[0]["location"] is None


def test_validation_names_every_fault(spark):
    valid, rejected = validate_events(record(spark, user_id=None, event_type="invalid_type", location=("US", None)))
    assert valid.isEmpty()
    assert rejected.first()["reject_reasons"] == ["user_id is missing", "location.city is missing", "event_type is unknown"]


def test_validation_fills_defaults_repeatably(spark):
    bare = record(spark, event_id=None, schema_version=None)
    first, second = (validate_events(bare)[0].first() for _ in range(2))
    assert first["schema_version"] == "1.0" and first["event_id"] and first["event_id"] == second["event_id"]


def test_history_includes_both_ends(spark, tmp_path):
    events = [record(spark, event_id=str(m), timestamp=T0 + timedelta(minutes=m)) for m in (-1, 0, 30, 31)]
    for event in events:
        encode_events(event).select(F.col("value").cast("string")).write.mode("append").text(f"{tmp_path}/e")
    found = read_event_history(spark, T0, T0 + timedelta(minutes=30), folder=f"{tmp_path}/e")
    assert values(found, "event_id") == [("0",), ("30",)]


def test_user_name_is_the_padded_number(spark):
    numbers = [0, 7, 99_999, 100_000, 1_234_567]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select(user_name("n")).collect()
    assert [r[0] for r in rows] == [f"usr_{n:05d}" for n in numbers]


# Append-only tables -----------------------------------------------------------------------------------------


def test_states_by_time(spark, tmp_path):
    history = FeatureHistory(spark, f"{tmp_path}/h")
    history.append(vectors(spark, ("a", 0, 1, 1)), written_at=100.0)
    history.append(vectors(spark, ("a", 1440, 2, 2)), written_at=200.0)
    history.append(vectors(spark, ("a", 0, 3, 3), ("b", 0, 3, 4)), written_at=300.0)
    assert values(history.read(as_of=100.0), "user_id", "avg_spend_1h") == [("a", 1.0)]
    assert values(history.read(as_of=250.0), "user_id", "avg_spend_1h") == [("a", 1.0), ("a", 2.0)]
    assert values(history.read(), "user_id", "avg_spend_1h") == [("a", 2.0), ("a", 3.0), ("b", 4.0)]
    assert history.read(as_of=99.0).isEmpty()
    training = history.read_for_training(as_of=300.0, cohort=["b"])
    assert training.columns == ["user_id", *FEATURES, "computed_at", "event_date"] and training.count() == 1


def test_interleaved_writers_keep_all_rows(spark, tmp_path):
    """Two writers that both begin before either ends: the rows of both are there, and each window once."""
    path = f"{tmp_path}/h"
    history = FeatureHistory(spark, path)
    history.append(vectors(spark, ("zero", 0, 1, 0)), written_at=1.0)
    one, two = FeatureHistory(spark, path), FeatureHistory(spark, path)
    slow, quick = (one.dated(vectors(spark, (u, 0, 1, v), ("both", 0, 1, v))) for u, v in (("A", 1), ("B", 2)))
    two.table.append(quick, "quick", 2.0)
    one.table.append(slow, "slow", 3.0)
    assert values(history.read(), "user_id", "avg_spend_1h") == [("A", 1.0), ("B", 2.0), ("both", 1.0), ("zero", 0.0)]
    # Writing at the same time, from threads.
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: FeatureHistory(spark, path).append(vectors(spark, (f"t{i}", i, 1, i))), range(8)))
    assert {f"t{i}" for i in range(8)} <= {u for u, in values(history.read(), "user_id")}
    assert history.read().count() == 12


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    history = FeatureHistory(spark, f"{tmp_path}/h")
    batch = vectors(spark, ("a", 0, 1, 1))
    assert history.append(batch, "q/0") == history.append(batch, "q/0")
    assert history.table.rows().count() == 1
    history.append(batch, "q/1")
    assert history.table.rows().count() == 2 and history.read().count() == 1


def test_a_backfill_beside_a_stream_leaves_one_row_per_window(spark, tmp_path):
    history = FeatureHistory(spark, f"{tmp_path}/h")
    history.append(vectors(spark, ("a", 0, 900, 1), ("a", 5, 900, 2), ("b", 10, 900, 3), ("a", 90, 900, 4)), "stream-1", 10.0)
    fresh = vectors(spark, ("a", 0, 0, 7), ("b", 10, 0, 8))
    history.replace_range(fresh, T0, T0 + timedelta(hours=1), written_at=20.0)
    assert values(history.read(), "user_id", "avg_spend_1h") == [("a", 4.0), ("a", 7.0), ("b", 8.0)]
    assert history.read(as_of=10.0).count() == 4
    # The window the backfill removed comes back if it is written again.
    history.append(vectors(spark, ("a", 5, 1, 9)), written_at=30.0)
    assert values(history.read(), "avg_spend_1h") == [(4.0,), (7.0,), (8.0,), (9.0,)]


def test_compaction_of_closed_days(spark, tmp_path):
    history = FeatureHistory(spark, f"{tmp_path}/h")
    for i in range(3):
        history.append(vectors(spark, ("a", i, i, i), ("a", 1440 + i, i, i), ("c", 0, i, i)), written_at=float(i))
    before, then = (values(history.read(at), "user_id", "window_start", "computed_at") for at in (None, 1.0))
    assert history.compact("2024-01-02", keep_since=1.0) == ["2024-01-01"]
    assert [len(history.table.batches(d)) for d in history.table.partitions()] == [1, 3]
    assert values(history.read(), "user_id", "window_start", "computed_at") == before
    assert values(history.read(1.0), "user_id", "window_start", "computed_at") == then
    assert history.compact("2024-01-03") == ["2024-01-02"] and history.compact("2024-01-03") == []
    assert values(history.read(), "user_id", "window_start", "computed_at") == before
    assert history.retain("2024-01-02") == ["2024-01-01"]
    assert {d for d, in values(history.read(), "event_date")} == {date(2024, 1, 2)}


def test_failed_append_is_set_aside_and_replayed(spark, tmp_path):
    history = FeatureHistory(spark, f"{tmp_path}/h")
    history.append(vectors(spark, ("a", 0, 1, 1)), written_at=1.0)
    working = history.table.append
    history.table.append = None
    batch = vectors(spark, ("b", 0, 1, 1))
    assert not history.append_or_set_aside(batch, "q/7")
    assert not history.append_or_set_aside(batch, "q/7")
    assert history.read().count() == 1
    history.table.append = working
    assert history.replay(written_at=2.0) == ["q-7"] and history.replay() == []
    assert values(history.read(), "user_id") == [("a",), ("b",)]


def test_nothing_to_append(spark, tmp_path):
    history = FeatureHistory(spark, f"{tmp_path}/h")
    history.append(vectors(spark))
    assert not history.table.exists()
    history.append(vectors(spark, ("a", 0, 1, 1)))
    history.append(vectors(spark))
    assert history.read().count() == 1


def test_partition_columns_and_filter(spark):
    row = with_partition_columns(vectors(spark, ("usr_1", 0, 86400 * 2 - 1, 1)), prefix=True)
    assert (row.first()["event_date"], row.first()["user_prefix"]) == (date(1970, 1, 2), "usr")
    assert row.filter(partition_filter("1970-01-02", "usr")).count() == 1
    assert row.filter(partition_filter(date(1970, 1, 2), "abc")).isEmpty()


def test_read_prunes_to_partitions(spark, tmp_path):
    history = FeatureHistory(spark, f"{tmp_path}/h")
    history.append(vectors(spark, ("a", 0, 1, 1), ("a", 1440, 1, 1)))
    plan = history.read().filter(partition_filter("2024-01-02")).select("avg_spend_1h")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "txn_count_5m:double" not in plan.split("ReadSchema: ")[-1]
    ranged = history.read_range(T0 + timedelta(days=1), T0 + timedelta(days=2))
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and values(ranged, "event_date") == [(date(2024, 1, 2),)]


def test_users_are_read_from_their_buckets(spark, tmp_path):
    online = OnlineStore(spark, f"{tmp_path}/o", buckets=16)
    online.write(vectors(spark, *[(f"u{i}", 0, 0, i) for i in range(200)]))
    asked = spark.createDataFrame([("u7",), ("unknown",)], "user_id string")
    found = online.read_users(asked)
    assert values(found, "user_id", "avg_spend_1h") == [("u7", 7.0)]
    assert "PartitionFilters: [" in (plan := found._jdf.queryExecution().executedPlan().toString())
    assert "user_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


# Online store ---------------------------------------------------------------------------------------------


def test_online_keeps_the_latest_and_expires(spark, tmp_path):
    online = OnlineStore(spark, f"{tmp_path}/o", buckets=3)
    online.write(vectors(spark, ("a", 0, 10, 1), ("a", 5, 20, 2), ("b", 0, 0, 3)), ttl=100)
    online.write(vectors(spark, ("a", 0, 30, 9)), ttl=100)  # an older window, replayed
    assert values(online.read(50), "user_id", "avg_spend_1h", "expires_at") == [("a", 2.0, 120.0), ("b", 3.0, 100.0)]
    assert values(online.read(100), "user_id") == [("a",)]
    assert values(online.active_users(), "user_id") == [("a",), ("b",)]
    assert values(online.active_users(110), "user_id") == [("a",)]


def test_extending_touches_live_rows_only(spark, tmp_path):
    online = OnlineStore(spark, f"{tmp_path}/o", buckets=3)
    online.write(vectors(spark, ("a", 0, 0, 1), ("b", 0, 50, 2), ("c", 0, 50, 3)), ttl=100)
    users = spark.createDataFrame([("a",), ("b",), ("unknown",)], "user_id string")
    online.extend(users, now=120, ttl=300)
    assert values(online.read_all(), "user_id", "computed_at", "expires_at") == [
        ("a", 0.0, 100.0), ("b", 50.0, 420.0), ("c", 50.0, 150.0),
    ]


def test_refresh_compaction_and_expiry_job(spark, tmp_path):
    online = OnlineStore(spark, f"{tmp_path}/o", buckets=3)
    online.write(vectors(spark, ("a", 0, 0, 1), ("b", 0, 0, 1), ("c", 0, 100, 1)), ttl=100)
    users = spark.createDataFrame([("b",)], "user_id string")
    jobs.refresh_features(online, users, lambda chosen: vectors(spark, ("b", 5, 60, 7)).join(chosen, "user_id", "left_semi"))
    assert values(online.read(110), "user_id", "avg_spend_1h") == [("b", 7.0), ("c", 1.0)]
    stale = jobs.refresh_expiry(online, now=50, threshold=60)
    assert values(stale, "user_id", "ttl") == [("a", 50)]
    assert values(online.read_all().filter("user_id = 'a'"), "expires_at") == [(350.0,)]
    before = values(online.read_all(), "user_id", "avg_spend_1h", "expires_at")
    online.compact()
    assert values(online.read_all(), "user_id", "avg_spend_1h", "expires_at") == before
    online.compact(drop_expired_before=355)
    assert all(len(online.table.batches(b)) <= 1 for b in online.table.partitions())
    assert values(online.read_all(), "user_id") == [("b",)]


# Baselines and jobs ---------------------------------------------------------------------------------------


def test_baselines_are_replaced_per_feature_and_expire(spark, tmp_path):
    baselines = Baselines(spark, f"{tmp_path}/b")
    assert baselines.load(0).isEmpty()
    schema = "feature_name string, value double"
    baselines.save(spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 3.0)], schema), now=0, ttl=10)
    baselines.save(spark.createDataFrame([("x", 9.0)], schema), now=5, ttl=10)
    assert values(baselines.load(9), "feature_name", "value") == [("x", 9.0), ("y", 3.0)]
    assert values(baselines.load(12), "feature_name") == [("x",)]
    assert baselines.exists("y", 9) and not baselines.exists("y", 10) and not baselines.exists("z", 0)


def test_backfill_can_be_repeated_and_verified(spark, small, tmp_path):
    events = read_activity(spark, small)
    history = FeatureHistory(spark, f"{tmp_path}/h")
    start, end = datetime(2024, 1, 5), datetime(2024, 1, 9, 18)
    jobs.backfill(history, events, start, end)
    once = values(history.read(), "user_id", "window_start", *FEATURES)
    jobs.backfill(history, events, datetime(2024, 1, 7), end)
    jobs.backfill(history, events, start, end)
    assert values(history.read(), "user_id", "window_start", *FEATURES) == once
    assert once == values(backfill_vector(events, start, end), "user_id", "window_start", *FEATURES)
    check = jobs.verify_backfill(history, events, start, end).collect()
    assert len(check) == 5 and all(r["agrees"] for r in check)
    assert not all(r["agrees"] for r in jobs.verify_backfill(history, events, start, datetime(2024, 1, 12)).collect())
    assert jobs.training_set(history).count() == len(once)
    labels = spark.createDataFrame([(once[-1][0], datetime(2024, 1, 30))], "user_id string, label_ts timestamp_ntz")
    newest = max(w for u, w, *_ in once if u == once[-1][0])
    assert jobs.training_set(history, labels=labels).first()["window_start"] == newest


def test_consistency_job(spark, tmp_path):
    history, online = FeatureHistory(spark, f"{tmp_path}/h"), OnlineStore(spark, f"{tmp_path}/o", 2)
    metrics = metric_log(spark, f"{tmp_path}/m")
    stored = [(f"u{i}", 0, 10, i + 1) for i in range(10)]
    history.append(vectors(spark, *stored, ("u0", 5, 10, 99)))
    online.write(vectors(spark, *[(u, m, at, v * (2 if u == "u3" else 1)) for u, m, at, v in stored]))
    report = jobs.check_consistency(history, online, metrics, now=20, folder=f"{tmp_path}/alerts")
    row = report.first()
    assert (row["sample_size"], row["inconsistent_users"], row["worst_feature"]) == (10, 1, "txn_count_5m")
    assert values(metrics.read(), "feature_name", "metric_type", "metric_value") == [("all_features", "consistency_rate", 0.9)]
    alert = json.loads(spark.read.json(f"{tmp_path}/alerts").first()["value"])
    assert alert["severity"] == "high" and alert["alert_type"] == "training_serving_skew" and alert["timestamp"] == 20.0
    assert jobs.consistency_follow_up(report).count() == 1
    assert jobs.check_consistency(history, online, metrics, now=20, sample=3).first()["sample_size"] == 3


def test_consistency_job_compares_all_users(spark, tmp_path):
    history, online = FeatureHistory(spark, f"{tmp_path}/h"), OnlineStore(spark, f"{tmp_path}/o", 2)
    rows = vectors(spark, *[(f"u{i}", 0, 10, i + 1) for i in range(1500)])
    history.append(rows)
    online.write(rows)
    report = jobs.check_consistency(history, online, metric_log(spark, f"{tmp_path}/m"), now=20)
    assert report.first()["sample_size"] == 1500
    assert jobs.check_consistency(history, online, metric_log(spark, f"{tmp_path}/m"), now=10**6).first()["sample_size"] == 0


def test_drift_job(spark, small, tmp_path):
    online, baselines = OnlineStore(spark, f"{tmp_path}/o", 2), Baselines(spark, f"{tmp_path}/b")
    metrics, diagnoses = metric_log(spark, f"{tmp_path}/m"), diagnosis_log(spark, f"{tmp_path}/d")
    online.write(vectors(spark, *[(f"u{i}", 0, 10, i % 7) for i in range(200)]))
    jobs.refresh_baselines(online, baselines, now=11)
    calm = jobs.check_drift(online, baselines, metrics, diagnoses, now=12)
    assert {r["severity"] for r in calm.collect()} == {"ok"} and metrics.read().count() == 12
    online.write(vectors(spark, *[(f"u{i}", 5, 20, 50 + i % 7) for i in range(200)]))
    report = jobs.check_drift(online, baselines, metrics, diagnoses, now=21)
    assert {r["severity"] for r in report.collect()} == {"alert"}
    found = diagnoses.read().collect()
    assert {r["feature_name"] for r in found} == set(FEATURES)
    assert {r["cause_category"] for r in found} == {"data_pipeline_delay"}
    assert len(found[0]["remediation_steps"]) == 4


def test_maintenance(spark, tmp_path):
    history, online = FeatureHistory(spark, f"{tmp_path}/h"), OnlineStore(spark, f"{tmp_path}/o", 2)
    history.append(vectors(spark, ("a", 0, 1, 1)))
    online.write(vectors(spark, ("a", 0, 1, 1)), ttl=10)
    history.append(vectors(spark, ("b", 0, 1, 1), ("b", 1440, 1, 1)))
    cells = BatchTable(spark, f"{tmp_path}/c", ("user_id",))
    for name in ("one", "two"):
        cells.append(FeatureHistory.dated(vectors(spark, ("a", 0, 1, 1))), name)
    at = datetime(2024, 1, 2, 12, tzinfo=timezone.utc).timestamp()
    assert jobs.maintain(history, online, [cells], now=at) == ["2024-01-01"]
    assert cells.batches("2024-01-01") != [] and len(cells.batches("2024-01-01")) == 1
    assert history.read().count() == 3 and (not online.table.exists() or online.read_all().isEmpty())
    jobs.maintain(history, online, [cells], now=at, keep_days=0)
    assert history.read().count() == 1 and not cells.exists()


def test_plain_scan_reads_only_needed_columns(spark, small):
    plan = feature_vector(read_activity(spark, small)).select("txn_count_5m")._jdf.queryExecution().toString()
    assert "event_id" not in plan.split("ReadSchema: ")[-1]
