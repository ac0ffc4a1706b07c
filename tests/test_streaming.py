"""Streamed and batch features are equal, batches can be repeated, late rows are dropped."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from windrow.operators.cells import cells, fold_cells, session_cells
from windrow.operators.latest import latest_per_user
from windrow.operators.vector import feature_vector
from windrow.plans.jobs import stream_features
from windrow.schema import EVENT_SCHEMA, FEATURES
from windrow.sources.activity import read_activity
from windrow.sources.events import encode_events, parse_events, read_event_stream
from windrow.sources.stores import FeatureHistory, OnlineStore, metric_log
from windrow.streaming.features import LateRows, cell_table, compact_cells, start_history, start_online

SENTINEL = "sentinel"


def assert_same(left, right, tolerance=1e-9):
    keys = ["user_id", "window_start"]
    a = left.toPandas().sort_values(keys).reset_index(drop=True)
    b = right.select(*left.columns).toPandas().sort_values(keys).reset_index(drop=True)
    assert a[keys].equals(b[keys])
    for c in left.columns:
        if c not in (*keys, "window_end"):
            assert (a[c] - b[c]).abs().max() < tolerance, c


@pytest.fixture(scope="module")
def replay(spark, small, tmp_path_factory):
    """The events table as JSON lines in four files by time, then one event a day later, then a late one."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = read_activity(spark, small).withColumn("timestamp", F.col("timestamp").cast("timestamp")).cache()
    start, end = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    step = (end - start) / 4
    for i in range(4):
        low, high = start + i * step, start + (i + 1) * step
        inside = (F.col("timestamp") >= F.lit(low)) & ((F.col("timestamp") < F.lit(high)) | F.lit(i == 3))
        lines = encode_events(events.filter(inside)).select(F.col("value").cast("string"))
        lines.coalesce(1).write.mode("append").text(folder)
    for at in (end + timedelta(days=1), start):
        row = [("x", SENTINEL, "s", "page_view", at, 0.0)]
        line = encode_events(spark.createDataFrame(row, events.schema)).select(F.col("value").cast("string"))
        line.coalesce(1).write.mode("append").text(folder)
    yield folder, events, end
    events.unpersist()


def test_folded_session_cells_equal_cells(spark, small):
    events = read_activity(spark, small)
    for base in ("5 minutes", "1 day"):
        assert_same(cells(events, base), fold_cells(session_cells(events, base)))


def test_fold_keeps_precision_of_close_large_amounts(spark):
    at = datetime(2024, 1, 1)
    rows = [("u", f"s{i % 3}", "purchase", at, 1e6 + i * 1e-3) for i in range(30)]
    events = spark.createDataFrame(
        rows, "user_id string, session_id string, event_type string, timestamp timestamp, transaction_amount double"
    )
    exact = sum((i * 1e-3 - 14.5e-3) ** 2 for i in range(30))
    for frame in (cells(events), fold_cells(session_cells(events))):
        assert frame.first()["m2_amount"] == pytest.approx(exact, rel=1e-5)


def test_history_query_equals_batch(spark, replay, tmp_path):
    folder, events, _ = replay
    history = FeatureHistory(spark, f"{tmp_path}/history")
    table = cell_table(spark, f"{tmp_path}/cells")

    def run():
        stream = parse_events(read_event_stream(spark, folder=folder, max_files=1))
        query = start_history(stream, history, table, f"{tmp_path}/checkpoint", trigger=None, clock=lambda: 1.0)
        assert query.awaitTermination(600)
        return query

    late = LateRows(metric_log(spark, f"{tmp_path}/metrics"), clock=lambda: 5.0)
    spark.streams.addListener(late)
    run()
    for _ in range(100):
        if late.total:
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.total == 1
    logged = late.metrics.read().collect()
    assert [(r.feature_name, r.metric_type, r.metric_value) for r in logged] == [("feature_history", "late_rows", 1.0)]
    expected = feature_vector(events, computed_at=F.lit(1.0)).select("user_id", "window_start", "window_end", *FEATURES)
    assert_same(expected, history.read())
    # Several batches were written; a restart from the checkpoint has nothing left to do.
    before = history.table.rows().count()
    assert len({b for d in history.table.partitions() for b in history.table.batches(d)}) >= 4
    run()
    assert history.table.rows().count() == before


def test_events_sent_twice_count_once(spark, small, tmp_path):
    events = read_activity(spark, small).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    again = events.filter(F.crc32("event_id") % 3 == 0)
    lines = encode_events(events.unionByName(again)).select(F.col("value").cast("string"))
    lines.coalesce(1).write.text(f"{tmp_path}/events")
    online = OnlineStore(spark, f"{tmp_path}/online", buckets=4)
    stream = parse_events(read_event_stream(spark, folder=f"{tmp_path}/events"))
    query = start_online(
        stream, online, cell_table(spark, f"{tmp_path}/live"), f"{tmp_path}/checkpoint", trigger=None, clock=lambda: 1.0
    )
    assert query.awaitTermination(600)
    expected = latest_per_user(feature_vector(events, computed_at=F.lit(1.0)))
    assert_same(expected.select("user_id", "window_start", *FEATURES), online.read(now=2.0))


def test_online_query_ends_at_the_latest_vectors(spark, replay, tmp_path):
    folder, events, end = replay
    online = OnlineStore(spark, f"{tmp_path}/online", buckets=4)
    stream = parse_events(read_event_stream(spark, folder=folder, max_files=1))
    query = start_online(
        stream, online, cell_table(spark, f"{tmp_path}/live"), f"{tmp_path}/checkpoint", trigger=None, clock=lambda: 1.0
    )
    assert query.awaitTermination(600)
    expected = latest_per_user(feature_vector(events, computed_at=F.lit(1.0)))
    assert_same(expected.select("user_id", "window_start", *FEATURES), online.read(now=2.0))
    assert online.read(now=301.0).isEmpty()


def test_stream_job_drops_invalid_events_and_live_cells_fold(spark, tmp_path):
    at = datetime(2024, 1, 1, 12)

    def write(*rows):
        full = [
            (f"e{m}{u}", u, "s", kind, at + timedelta(minutes=m), 5.0, "p", "home", ("US", "Austin"), device, None)
            for u, m, kind, device in rows
        ]
        lines = encode_events(spark.createDataFrame(full, EVENT_SCHEMA)).select(F.col("value").cast("string"))
        lines.coalesce(1).write.mode("append").text(f"{tmp_path}/events")

    def run():
        for query in stream_features(spark, f"{tmp_path}/t", f"{tmp_path}/c", trigger=None, folder=f"{tmp_path}/events"):
            assert query.awaitTermination(300)

    write(("a", 0, "purchase", "mobile"), ("b", 1, "purchase", "toaster"))
    run()
    write(("a", 2, "purchase", "mobile"), ("a", 60, "page_view", "tablet"))
    run()
    online = OnlineStore(spark, f"{tmp_path}/t/online").read_all().collect()
    assert [(r["user_id"], r["txn_count_5m"]) for r in online] == [("a", 2.0)]
    stored = FeatureHistory(spark, f"{tmp_path}/t/history").read().collect()
    assert [(r["user_id"], r["txn_count_5m"]) for r in stored] == [("a", 2.0)]

    live = cell_table(spark, f"{tmp_path}/t/live_cells")
    assert live.rows().count() == 3
    assert compact_cells(live, "2024-01-02") == ["2024-01-01"]
    assert sorted(r["n_events"] for r in live.rows().collect()) == [1, 2]
    assert compact_cells(live, "2024-01-02") == []
