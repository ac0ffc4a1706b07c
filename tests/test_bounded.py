"""The bounded stream source and the sink of committed batches."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition
from pyspark.sql.types import StructType

from windrow.sources.bounded import (
    BatchWriter,
    BoundedReader,
    committed_batches,
    last_by_key,
    read_bounded,
    read_committed,
    start_committed,
)

SCHEMA = "id long, text string"


def arrive(folder, name, ids, group=1000):
    os.makedirs(folder, exist_ok=True)
    rows = {"extra": pa.array(ids, pa.int64()), "id": pa.array(ids, pa.int64()), "text": [None if i % 7 == 0 else f"t{i}" for i in ids]}
    pq.write_table(pa.table(rows), f"{folder}/{name}.parquet", row_group_size=group)


def go(spark, tmp_path, limit, fail_at=None):
    stream = read_bounded(spark, f"{tmp_path}/in", limit, SCHEMA)
    if fail_at is not None:
        stream = stream.withColumn("id", F.when(F.col("id") == fail_at, F.raise_error(F.lit("killed"))).otherwise(F.col("id")))
    query = start_committed(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def sizes(spark, tmp_path):
    return [r.n_rows for r in committed_batches(spark, f"{tmp_path}/out").orderBy("batch").collect()]


def ids(spark, tmp_path):
    return sorted(r.id for r in read_committed(spark, f"{tmp_path}/out", SCHEMA).collect())


def test_no_batch_above_the_limit_and_restarts_go_on_inside_files(spark, tmp_path):
    arrive(f"{tmp_path}/in", "a", range(95), group=40)
    arrive(f"{tmp_path}/in", "b", [])
    arrive(f"{tmp_path}/in", "c", range(95, 100))
    go(spark, tmp_path, 30)
    assert sizes(spark, tmp_path) == [30, 30, 30, 10]
    # The query is started anew, over more files and with another limit.
    arrive(f"{tmp_path}/in", "d", range(100, 150))
    go(spark, tmp_path, 35)
    assert sizes(spark, tmp_path) == [30, 30, 30, 10, 35, 15]
    go(spark, tmp_path, 35)
    assert ids(spark, tmp_path) == list(range(150))
    texts = {r.id: r.text for r in read_committed(spark, f"{tmp_path}/out", SCHEMA).collect()}
    assert texts[7] is None and texts[8] == "t8"


def test_restart_in_the_middle_of_a_file(spark, tmp_path):
    arrive(f"{tmp_path}/in", "a", range(100), group=33)
    with pytest.raises(StreamingQueryException):
        go(spark, tmp_path, 30, fail_at=70)
    assert sizes(spark, tmp_path) == [30, 30]
    go(spark, tmp_path, 25)
    # The killed batch is run again as it was planned; what follows takes the new limit.
    assert sizes(spark, tmp_path) == [30, 30, 30, 10]
    assert ids(spark, tmp_path) == list(range(100))


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    arrive(f"{tmp_path}/in", "a", range(40))
    go(spark, tmp_path, 20)
    # As if the query had died between the sink's commit and its own.
    commits = f"{tmp_path}/checkpoint/commits"
    for name in os.listdir(commits):
        if name.strip(".").split(".")[0] == "1":
            os.remove(f"{commits}/{name}")
    go(spark, tmp_path, 20)
    assert sizes(spark, tmp_path) == [20, 20]
    assert ids(spark, tmp_path) == list(range(40))
    data = os.listdir(f"{tmp_path}/out/data")
    listed = [f for r in committed_batches(spark, f"{tmp_path}/out").collect() for f in r.files]
    assert sorted(f for f in data if f.endswith(".parquet")) == sorted(listed)


def test_files_of_dead_tasks_and_aborted_batches_are_not_read(spark, tmp_path):
    schema = StructType.fromDDL(SCHEMA)
    writer = BatchWriter(f"{tmp_path}/out", schema)
    rows = pa.record_batch({"id": pa.array([1, 2]), "text": ["x", None]})
    lost, kept, void = writer.write(iter([rows])), writer.write(iter([rows])), writer.write(iter([]))
    writer.commit([kept, void, None], 0)
    assert lost.n_rows == 2 and void.n_rows == 0
    assert ids(spark, tmp_path) == [1, 2]
    gone = writer.write(iter([rows]))
    writer.abort([gone, None], 1)
    writer.commit([], 1)
    assert sizes(spark, tmp_path) == [2, 0]
    assert ids(spark, tmp_path) == [1, 2]
    with open(f"{tmp_path}/out/batches/{0:012d}.json") as f:
        assert json.load(f)["files"] == [kept.name]


def test_offsets_and_pieces(tmp_path):
    folder, schema = f"{tmp_path}/in", StructType.fromDDL(SCHEMA)
    reader = BoundedReader(folder, schema, 10)
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.BEGIN, reader.BEGIN) == []
    arrive(folder, "a", range(12), group=4)
    arrive(folder, "_hidden", range(5))
    end = reader.latestOffset()
    assert end == reader.latestOffset() == {"file": "a.parquet", "records": 10}
    pieces = [p.value for p in reader.partitions(reader.BEGIN, end)]
    assert pieces == [("a.parquet", 0, 0, 4), ("a.parquet", 1, 0, 4), ("a.parquet", 2, 0, 2)]
    got = [i for p in pieces for b in reader.read(InputPartition(p)) for i in b.column("id").to_pylist()]
    assert got == list(range(10))
    last = reader.latestOffset()
    assert last == {"file": "a.parquet", "records": 12}
    assert [p.value for p in reader.partitions(end, last)] == [("a.parquet", 2, 2, 4)]
    with pytest.raises(ValueError):
        reader.partitions(last, end)
    with pytest.raises(ValueError):
        BoundedReader(folder, schema, 0)


def test_last_by_key(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 1, "n"), ("b", None, None)], "k string, t int, v string")
    assert {tuple(r) for r in last_by_key(rows, ["k"], ["t"]).collect()} == {("a", 2, "z"), (None, 1, "n"), ("b", None, None)}
