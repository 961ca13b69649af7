"""Streaming over file changes: bursts, staleness, a live index, live histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from arborist.functions.paths import glob_extension, glob_prefix, glob_to_regex, normalize_path, path_glob_keys
from arborist.functions.rules import WATCH_IGNORED
from arborist.operators.history import latest_by_key
from arborist.operators.search import text_tokens
from arborist.session import cut_lineage, drop_path

CHANGE_SCHEMA = (
    "project STRING, ref STRING, path STRING, status STRING, seq BIGINT, ts TIMESTAMP"
)


def filter_ignored(changes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop changes whose path has an ignored name as a segment; works on streams and tables."""
    parts = F.split("path", "/")
    return changes.where(~F.exists(parts, lambda p: p.isin(*(names or WATCH_IGNORED))))


def change_bursts(changes: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Trailing debounce: each change restarts the timer, one row per quiet gap.

    On a stream, changes later than `late` are dropped by the watermark.  The
    last burst is emitted once the watermark passes its end.
    """
    source = changes.withWatermark("ts", late) if changes.isStreaming else changes
    return (
        source.groupBy("project", F.session_window("ts", gap).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("changes"),
            F.max("ts").alias("last_at"),
            F.max_by("path", F.struct("ts", "seq")).alias("last_path"),
        )
        .select("project", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes", "last_at", "last_path")
    )


def _base(elements: DataFrame) -> Column:
    """The commit an element was recorded at, where the table has one."""
    return (F.col("git_commit") if "git_commit" in elements.columns else F.lit(None).cast("string")).alias("base")


def _glob_keys(elements: DataFrame) -> DataFrame:
    return elements.select("project", F.col("path").alias("element"), _base(elements), F.explode("source_globs").alias("glob")).select(
        "project",
        "element",
        "base",
        glob_prefix(F.col("glob")).alias("g_prefix"),
        glob_extension(F.col("glob")).alias("g_ext"),
        glob_to_regex(F.col("glob")).alias("g_regex"),
    )


def stale_stream(changes: DataFrame, elements: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Changes -> stale elements as they come (project, element, path, reason, ts).

    A change counts when it is in the working tree (no ref) or recorded since
    the element's own commit, as in the batch plan.  Stream-static joins: the
    exact path is one equi-join, globs another on their literal prefix and
    extension.  An element is told once per path within the watermark.
    """
    counts = F.col("ref").isNull() | F.col("base").isNull() | (F.col("ref") == F.col("base"))
    counts = counts if "git_commit" in elements.columns else F.lit(True)
    source = changes.withWatermark("ts", late) if changes.isStreaming else changes
    tracked = elements.select("project", F.col("path").alias("element"), _base(elements), F.explode("source_files").alias("file")).select(
        "project", "element", "base", normalize_path(F.col("file")).alias("clean"), F.lit("source_file").alias("reason")
    )
    exact = source.withColumn("clean", normalize_path(F.col("path"))).join(tracked, ["project", "clean"]).where(counts)
    keyed = source.select("project", "ref", "path", "ts", F.inline(path_glob_keys(F.col("path"))))
    by_glob = keyed.join(_glob_keys(elements), ["project", "g_prefix", "g_ext"]).where(F.expr("path RLIKE g_regex") & counts)
    cols = ["project", "element", "path", "reason", "ts"]
    both = exact.select(*cols).unionByName(by_glob.withColumn("reason", F.lit("source_glob")).select(*cols))
    keys = ["project", "element", "path"]
    return both.dropDuplicatesWithinWatermark(keys) if changes.isStreaming else both.dropDuplicates(keys)


FIELD_KEYS = ["project", "path", "field"]


def live_index(field_stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep a search index current from a stream of field writes: a batch `every` so often, or all there is, then stop.

    Each batch adds one folder with the newest text of every field it touched
    and one with that text's postings, so a batch costs what it holds, not what
    the index holds.  A replayed batch overwrites its own folders.  Readers
    (`live_fields`, `live_postings`) let the newest version of a field win.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        newest = cut_lineage(latest_by_key(batch, FIELD_KEYS, ["ts", "seq"]))
        newest.write.mode("overwrite").parquet(f"{path}/fields/batch={batch_id}")
        postings = (
            newest.select(*FIELD_KEYS, "ts", "seq", F.explode(text_tokens(F.col("text"))).alias("term"))
            .groupBy(*FIELD_KEYS, "ts", "seq", "term")
            .agg(F.count(F.lit(1)).alias("tf"))
        )
        postings.write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id}")

    return (
        field_stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def compact_index(spark: SparkSession, path: str) -> None:
    """Rewrite a live index as one batch of current versions, and drop the folders it replaces.

    Run it between runs of the stream.  Readers let the newest version win, so
    an index whose compaction broke off half way reads the same.
    """
    last = spark.read.parquet(f"{path}/fields").agg(F.max("batch")).first()[0]
    for part, current in (("postings", _current_postings(spark, path)), ("fields", live_fields(spark, path))):
        stored = cut_lineage(current)
        stored.write.mode("overwrite").parquet(f"{path}/{part}/batch={last}")
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        system = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in system.listStatus(jvm_path):
            name = status.getPath().getName()
            if name.startswith("batch=") and name != f"batch={last}":
                drop_path(spark, status.getPath().toString())


def live_fields(spark: SparkSession, path: str) -> DataFrame:
    """Current text of every field of a live index."""
    return latest_by_key(spark.read.parquet(f"{path}/fields"), FIELD_KEYS, ["ts", "seq"]).drop("batch")


def _current_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings of the newest version of every field."""
    stored = spark.read.parquet(f"{path}/fields").groupBy(*FIELD_KEYS).agg(F.max(F.struct("ts", "seq")).alias("v"))
    versions = stored.select(*FIELD_KEYS, "v.ts", "v.seq")
    postings = spark.read.parquet(f"{path}/postings").drop("batch").dropDuplicates([*FIELD_KEYS, "ts", "seq", "term"])
    return postings.join(versions, [*FIELD_KEYS, "ts", "seq"], "left_semi")


def live_postings(spark: SparkSession, path: str) -> DataFrame:
    """Current postings (project, doc, term, tf) of a live index."""
    current = _current_postings(spark, path)
    return current.groupBy("project", F.col("path").alias("doc"), "term").agg(F.sum("tf").alias("tf"))


class _KeepLast(StatefulProcessor):
    """Last `keep` writes of one element, in order, as list state."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "at TIMESTAMP, seq LONG, text STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.items.get())
        for pdf in rows:
            held.extend(zip(pdf["written_at"], pdf["seq"], pdf["text"]))
            held = sorted(((pd.Timestamp(a), int(s), t) for a, s, t in held), key=lambda r: (r[0], r[1]))[-self.keep :]
        self.items.put([(a.to_pydatetime(), s, t) for a, s, t in held])
        yield pd.DataFrame(
            {
                "project": [key[0]] * len(held),
                "path": [key[1]] * len(held),
                "age": range(len(held), 0, -1),
                "text": [t for _, _, t in held],
            }
        )

    def close(self) -> None:
        pass


HISTORY_SCHEMA = ("project STRING, path STRING, age INT, text STRING")


def live_history(writes: DataFrame, keep: int = 20) -> DataFrame:
    """Bounded history per element, re-emitted whenever the element changes (update mode).

    State never holds more than `keep` writes of an element.  Needs the
    RocksDB state store.  A batch frame gives every element's history once.
    """
    _ = writes.sparkSession.streams.active  # starts the coordinator that state stores report to
    return writes.groupBy("project", "path").transformWithStateInPandas(
        statefulProcessor=_KeepLast(keep), outputStructType=HISTORY_SCHEMA, outputMode="Update", timeMode="None"
    )


