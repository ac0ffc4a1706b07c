"""Session settings the jobs expect, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Only settings that change results or survive-ability; sizes stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to an existing session (all are runtime settings)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(name: str = "windrow", **extra: str) -> SparkSession:
    """Session for a spark-submit entry; the master and sizes come from the submit command.

    Keyed streaming state goes to RocksDB so that it does not live on the JVM heap.
    """
    builder = SparkSession.builder.appName(name).config(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the one named in ``spark.checkpoint.dir``.

    A session on a single machine, as in tests, may leave it unset and gets a temporary folder; a cluster may not, as its
    executors don't share one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set; name a folder every executor can reach")
    return tempfile.gettempdir()


def scratch_folder(spark: SparkSession) -> str:
    """A folder of its own under the shared one, removed when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/windrow-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder
