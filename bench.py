"""Times the headline queries on the tables in BENCH_SF_DIR and prints one JSON line.

``from_events`` queries start at the raw table. ``stored`` ones read vectors written once beforehand, as the
monitoring jobs do. Each is run once to warm up and then twice, and the faster run counts; results are consumed
in full by a sink that discards them. The stream is timed once, over the whole table.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.time import bound
from windrow.operators import consistency, distribution, drift, latest, serving
from windrow.operators.asof import point_in_time
from windrow.operators.samples import wide_to_long
from windrow.operators.vector import REFERENCE_WIDTHS
from windrow.plans.queries import NOW_EPOCH, SPLIT, activity_stream, all_queries, drift_samples, vectors
from windrow.session import SETTINGS, scratch_folder
from windrow.sources.activity import read_activity
from windrow.sources.stores import FeatureHistory, with_expiry
from windrow.streaming.features import cell_table, start_history

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

FROM_EVENTS = [
    "feature_vector",
    "feature_vector_dense",
    "backfill_vector",
    "txn_count",
    "avg_spend",
    "session_activity_rate",
    "cart_abandon_ratio",
    "product_interaction_freq",
    "anomaly_score",
    "parse_events",
    "latest_vector",
]


def timed(run) -> float:
    begun = time.perf_counter()
    run()
    return time.perf_counter() - begun


def consume(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("windrow-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    root = scratch_folder(spark)
    seconds: dict[str, float] = {}

    registered = all_queries()
    for name in FROM_EVENTS:
        runs = [timed(lambda: consume(registered[name](spark, FOLDER))) for _ in range(3)]
        seconds[name] = round(min(runs[1:]), 3)

    # Twenty thousand vectors at scale 0.1: more than the ten thousand users a drift report is measured on.
    vectors(spark, FOLDER, REFERENCE_WIDTHS).write.parquet(f"{root}/vectors")
    drift_samples(spark, FOLDER, REFERENCE_WIDTHS).write.parquet(f"{root}/samples")
    stored = spark.read.parquet(f"{root}/vectors")
    samples = spark.read.parquet(f"{root}/samples")
    online = with_expiry(latest.latest_per_user(stored), 2 * 86400)
    early = stored.filter(F.col("window_start") < bound(SPLIT))
    labels = read_activity(spark, FOLDER).select("user_id", F.col("timestamp").alias("label_ts"))
    reports = {
        "stored_detect_drift": lambda: drift.detect_drift(samples),
        "stored_psi": lambda: distribution.psi(samples),
        "stored_ks_2samp": lambda: distribution.ks_2samp(samples),
        "stored_kl_divergence": lambda: distribution.kl_divergence(samples),
        "stored_z_score": lambda: distribution.z_score(samples),
        "stored_feature_summary": lambda: distribution.feature_summary(wide_to_long(stored)),
        "stored_histogram": lambda: distribution.histogram(samples),
        "stored_consistency": lambda: consistency.validate_consistency(latest.latest_per_user(early), online),
        "stored_point_in_time": lambda: point_in_time(labels, stored),
        "stored_serve_features": lambda: serving.serve_features(online, labels.select("user_id").distinct(), NOW_EPOCH),
        "stored_freshness_report": lambda: serving.freshness_report(serving.freshness(online, NOW_EPOCH)),
    }
    for name, report in reports.items():
        runs = [timed(lambda: consume(report())) for _ in range(3)]
        seconds[name] = round(min(runs[1:]), 3)

    history = FeatureHistory(spark, f"{root}/history")
    cells = cell_table(spark, f"{root}/cells")
    stream = activity_stream(spark, FOLDER, root)
    query = start_history(stream, history, cells, f"{root}/checkpoint", trigger=None)
    seconds["streamed_history"] = round(timed(query.awaitTermination), 3)
    events = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    spark.stop()

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "stream_events_per_sec": round(events / seconds["streamed_history"]),
            }
        )
    )


if __name__ == "__main__":
    main()
