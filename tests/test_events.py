"""Events sent twice, sessions, and moments that don't depend on the driver's time zone."""

import os
import subprocess
import sys
from datetime import datetime, timedelta, timezone

from windrow.functions.time import bound
from windrow.sources.events import dedup_events, sessions

T0 = datetime(2024, 1, 1)
EVENT = "event_id string, user_id string, event_type string, timestamp timestamp_ntz, transaction_amount double"


def events(spark, *rows):
    return spark.createDataFrame([(i, u, k, T0 + timedelta(minutes=m), a) for i, u, k, m, a in rows], EVENT)


def test_the_first_of_an_id_stays(spark):
    found = dedup_events(
        events(spark, ("1", "a", "purchase", 5, 2.0), ("1", "a", "purchase", 0, 1.0), ("1", "a", "purchase", 0, 1.0),
               ("2", "a", "purchase", 0, 1.0), (None, "a", "search", 1, 0.0), (None, "a", "search", 1, 0.0))
    )
    got = sorted((r.event_id or "", r.timestamp, r.transaction_amount) for r in found.collect())
    minute = T0 + timedelta(minutes=1)
    assert got == [("", minute, 0.0), ("", minute, 0.0), ("1", T0, 1.0), ("2", T0, 1.0)]
    assert dedup_events(events(spark)).isEmpty()


def test_sessions_end_with_a_pause(spark):
    found = sessions(
        events(spark, ("1", "a", "search", 0, 0.0), ("2", "a", "purchase", 10, 1.0), ("3", "a", "search", 50, 0.0),
               ("4", "b", "purchase", 20, 1.0)),
        "30 minutes",
    )
    got = sorted((r.user_id, r.session_start, r.session_end, r.n_events, r.n_purchases) for r in found.collect())
    at = lambda m: T0 + timedelta(minutes=m)
    assert got == [("a", at(0), at(40), 2, 1), ("a", at(50), at(80), 1, 0), ("b", at(20), at(50), 1, 1)]


def test_sessions_of_the_table(spark):
    from windrow.sources.activity import read_activity

    assert sessions(read_activity(spark, "/root/testdata/sf0.01")).count() == 9549


def test_what_does_not_fit_is_rescued(spark):
    from windrow.sources.events import parse_events, parse_events_rescued

    fits = '{"event_id":"1","user_id":"u","event_type":"search","timestamp":"2024-01-01T00:00:00Z","transaction_amount":1.5,'
    rows = [
        fits + '"location":{"country":"US","city":null}}',
        fits + '"location":{"country":"US","zip":[1]},"new":{"a":null},"other":null}',
        '{"user_id":"v","timestamp":"soon","transaction_amount":"x","location":3}',
        '{"user_id":',
        "[1,2]",
        "",
        None,
    ]
    raw = spark.createDataFrame([(r,) for r in rows], "value string")
    found = parse_events_rescued(raw).collect()
    assert [r.rescued for r in found[:5]] == [
        None,
        {"location.zip": "[1]", "new": '{"a":null}', "other": "null"},
        {"timestamp": '"soon"', "transaction_amount": '"x"', "location": "3"},
        {"$": '{"user_id":'},
        {"$": "[1,2]"},
    ]
    assert found[1].location.country == "US" and found[1].transaction_amount == 1.5
    assert found[2].user_id == "v" and found[2].location is None
    assert [r.user_id for r in found[3:]] == [None] * 4
    # What fits is read as it is without rescue.
    same = ["event_id", "user_id", "event_type", "timestamp", "transaction_amount", "location"]
    assert parse_events_rescued(raw.limit(1)).select(*same).collect() == parse_events(raw.limit(1)).select(*same).collect()


def test_bounds_are_in_utc(spark):
    east = datetime(2024, 1, 1, 2, tzinfo=timezone(timedelta(hours=2)))
    row = spark.range(1).select(bound(T0).alias("a"), bound("2024-01-01").alias("b"), bound(east).alias("c")).first()
    assert set(row) == {T0}


ELSEWHERE = """
import sys
from pyspark.sql import SparkSession
from windrow.plans.queries import all_queries
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
for name in sys.argv[2:]:
    rows = all_queries()[name](spark, "/root/testdata/sf0.01")
    rows.selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in rows.columns]).write.parquet(f"{sys.argv[1]}/{name}")
"""


def test_results_do_not_depend_on_the_time_zone(spark, tmp_path):
    names = ["event_history", "backfill_vector", "streamed_history", "verify_backfill"]
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for zone in ("America/Los_Angeles", "UTC"):
        run = subprocess.run(
            [sys.executable, "-c", ELSEWHERE, f"{tmp_path}/{zone[:3]}", *names],
            env=os.environ | {"TZ": zone, "PYTHONPATH": here}, capture_output=True, text=True, timeout=600,
        )
        assert run.returncode == 0, run.stderr[-2000:]
    for name in names:
        west, utc = (sorted(map(str, spark.read.parquet(f"{tmp_path}/{z}/{name}").collect())) for z in ("Ame", "UTC"))
        assert west == utc and len(utc) > 0
