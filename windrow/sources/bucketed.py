"""Tables in buckets of their key, so that two of them meet without a shuffle.

A row a key is laid out once, when it is written, by the hash that joins use; every later join or aggregation on the key
between tables of as many buckets reads bucket beside bucket. Each write is a folder of its own under the table's path, so a
reader of the version before is not disturbed, and the catalog names the newest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class BucketedTable:
    """Rows by ``key`` in ``buckets`` files, sorted by it.

    Tables that are to meet without a shuffle have the same key type and number of buckets. ``name`` is the table's in the
    session's catalog; where the catalog does not outlive a session, ``attach`` names a folder again.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64, key: str = "user_id"):
        self.spark, self.name, self.path, self.buckets, self.key = spark, name, path.rstrip("/"), buckets, key

    def write(self, rows: DataFrame) -> str:
        """Replaces the table by ``rows``, with one shuffle by the key; returns the folder."""
        folder = f"{self.path}/{uuid.uuid4().hex}"
        laid = rows.repartition(self.buckets, self.key)
        writer = laid.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
        writer.mode("overwrite").option("path", folder).saveAsTable(self.name)
        return folder

    def attach(self, folder: str) -> None:
        """Names the rows of a folder that ``write`` has returned, in this or an earlier session."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(folder).schema)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(
            f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
            f"INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )

    def read(self) -> DataFrame:
        """The rows, for joins by merging: either side may be too large to be sent to all executors."""
        return self.spark.table(self.name).hint("merge")
