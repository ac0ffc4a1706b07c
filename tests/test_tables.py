"""Lookups between bucketed tables, and the feature function."""

import pytest
from pyspark.sql import functions as F

from windrow.operators.cells import cells
from windrow.operators.consistency import deviations
from windrow.operators.serving import serve_features
from windrow.operators.table_function import vector_by_function
from windrow.operators.vector import DENSE_WIDTHS, REFERENCE_WIDTHS, vector_from_cells
from windrow.schema import FEATURES
from windrow.sources.activity import read_activity
from windrow.sources.bucketed import BucketedTable


def plan_of(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def current(spark, shift, users):
    values = [(F.col("id") * (i + 1) + shift).cast("double").alias(c) for i, c in enumerate(FEATURES)]
    return spark.range(users).select(F.concat(F.lit("u"), "id").alias("user_id"), *values, F.lit(5.0).alias("computed_at"), F.lit(9.0).alias("expires_at"))


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    left, right = (BucketedTable(spark, f"tables_{n}", f"{tmp_path}/{n}", buckets=4) for n in ("left", "right"))
    left.write(current(spark, 0, 300))
    right.write(current(spark, 1, 200))
    compared = deviations(left.read(), right.read())
    plan = plan_of(compared)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = deviations(current(spark, 0, 300), current(spark, 1, 200))
    assert sorted(compared.collect()) == sorted(want.collect())
    served = serve_features(right.read(), left.read(), 8.0)
    plan = plan_of(served)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert served.filter("found").count() == 200 and served.count() == 300


def test_bucketed_table_is_replaced_and_attached_again(spark, tmp_path):
    table = BucketedTable(spark, "tables_again", f"{tmp_path}/again", buckets=4)
    first = table.write(current(spark, 0, 10))
    before = table.read()
    second = table.write(current(spark, 5, 20))
    assert before.count() == 10 and table.read().count() == 20
    spark.sql("DROP TABLE tables_again")
    table.attach(first)
    assert sorted(table.read().collect()) == sorted(current(spark, 0, 10).collect())
    table.attach(second)
    plan = plan_of(table.read().groupBy("user_id").count())
    assert "Exchange" not in plan and table.read().count() == 20
    table.write(current(spark, 0, 0))
    assert table.read().isEmpty()


def near(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("widths", [REFERENCE_WIDTHS, DENSE_WIDTHS])
def test_feature_function_equals_the_vector(spark, small, widths):
    cell = cells(read_activity(spark, small), widths.base)
    want = vector_from_cells(cell, widths)
    got = vector_by_function(cell, widths)
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    assert near(got.collect()) == near(want.collect())
    some = ["anomaly_score", "txn_count_5m"]
    part = vector_by_function(cell, widths, some)
    assert part.columns == ["user_id", "window_start", "window_end", "computed_at", *some]
    assert near(part.collect()) == near(want.select(part.columns).collect())


def test_feature_function_of_one_dense_user(spark):
    """A user over many stretches of time, with equal amounts and windows without any."""
    events = spark.range(20_000).select(
        F.lit("u").alias("user_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 97).alias("timestamp"),
        F.element_at(F.array(*map(F.lit, ("purchase", "add_to_cart", "page_view", "search"))), (1 + F.col("id") * 7 % 11 % 4).cast("int")).alias("event_type"),
        F.when(F.col("id") % 5 < 4, F.lit(1e6) + F.col("id") % 3).alias("transaction_amount"),
        F.concat(F.lit("s"), F.col("id") % 13).alias("session_id"),
    )
    cell = cells(events).cache()
    assert near(vector_by_function(cell).collect()) == near(vector_from_cells(cell).collect())
    assert vector_by_function(cell.limit(0)).isEmpty()


def test_feature_function_refuses_what_it_does_not_know(spark, small):
    cell = cells(read_activity(spark, small))
    with pytest.raises(Exception, match="no such features: .*surprise"):
        vector_by_function(cell, features=["surprise"]).collect()
    with pytest.raises(Exception, match="n_carts"):
        vector_by_function(cell.withColumnRenamed("n_carts", "other").withColumn("n_views", F.lit(1)).select("*", F.lit(1).alias("n_cart")).drop("n_carts")).collect()
