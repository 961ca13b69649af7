"""Session settings and lineage cutting for the iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that keep hot keys and small shuffles in hand.  All of them
# are session-level, so they work on a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # rows that tasks hand to Python at once: a few MB of text
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # keyed state on disk, without preallocated files
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # a hot key's session is merged within each partition before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


# Derived tables repeat their strings: as Parquet they are some 30 times smaller than as the rows that a broadcast
# holds on the driver.  Spark compares this multiple of a file's size with its broadcast limit.
ROWS_TO_FILE = "32.0"


def configure(spark: SparkSession, rows_to_file: str = "1.0") -> SparkSession:
    """Switch on adaptive execution and skew handling; leaves sizes to the cluster."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.sources.fileCompressionFactor", rows_to_file)
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, as `--py-files` would.

    The archive is built on the driver and served to the executors by Spark.
    """
    sc = spark.sparkContext
    name = f"arborist-{sc.applicationId}.zip"
    if any(f.endswith(name) for f in sc.listFiles):
        return spark
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="arborist-"), name)
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    archive.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in `spark.checkpoint.dir`; where that is unset, the
    tables go below the warehouse folder, which every session has and which a
    cluster keeps on shared storage as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        place = spark.conf.get("spark.sql.warehouse.dir")
        master = spark.sparkContext.master
        if place.startswith(("file:", "/")) and master != "local" and not master.startswith("local["):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all machines share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/arborist-{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a superseded intermediate folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.hadoop.fs.Path(source)
    if not old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(old, jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where it does not exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []


@contextmanager
def sorted_aggregates(spark: SparkSession) -> Iterator[None]:
    """Within it, groups over sorted rows are aggregated as the rows come: no hash table, and no second sort once it is full."""
    key = "spark.sql.execution.replaceHashWithSortAgg"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    The plan restarts from the written files, so rounds do not pile up in the
    lineage, a lost executor re-reads files instead of recomputing rounds, and
    Catalyst plans the next join from real file sizes.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place(df: DataFrame, keys: list[str], table: str = "", level: str | None = None) -> str:
    """Write `df` to a table in the shared folder, in as many buckets of `keys` as a shuffle has partitions; returns its name.

    Joins and groupings by the keys then read it where it lies.  With `table`, rows are appended to that; `level` divides
    its folder.  Rows that a shuffle by the keys has just brought together make a file per bucket.
    """
    spark = df.sparkSession
    name = table or f"arborist_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    if level:
        writer = writer.partitionBy(level)
    if not table:
        writer = writer.option("path", scratch(spark, "placed"))
    writer.mode("append").saveAsTable(name)
    return name
