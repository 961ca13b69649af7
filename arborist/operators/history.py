"""Histories and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborist.functions.common import top_n


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row of each key."""
    return top_n(df, keys, [F.desc(o) for o in order], 1)


def upsert_file_index(old: DataFrame, new: DataFrame, order: str = "last_analyzed") -> DataFrame:
    """Per-file index after an analysis: the newest row of each (project, path) wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_by_key(both, ["project", "path"], [order, "_new"]).drop("_new")


def diagram_history(writes: DataFrame, keep: int = 20) -> DataFrame:
    """The last `keep` replaced diagrams of each element; `age` 1 is the immediate predecessor.

    A write keeps the text it replaces, stamped with its own time, so the
    newest `keep + 1` writes of an element are all that is needed; the group
    limit cuts a hot element down before the shuffle.
    """
    keys = ["project", "path"]
    recent = top_n(writes.where("field = 'diagram'"), keys, [F.desc("written_at"), F.desc("seq")], keep + 1, rank="age")
    w = Window.partitionBy(*keys).orderBy(F.desc("age"))
    return (
        recent.withColumn("diagram", F.lag("text").over(w))
        .where("diagram IS NOT NULL")
        .select(*keys, "age", "diagram", F.col("written_at").alias("replaced_at"))
    )


def change_log(writes: DataFrame, keep: int = 50) -> DataFrame:
    """The last `keep` field writes of each element."""
    return top_n(writes, ["project", "path"], [F.desc("written_at"), F.desc("seq")], keep, rank="age").select(
        "project", "path", "age", "field", "written_at"
    )


def write_stats(writes: DataFrame) -> DataFrame:
    """Created, updated, number of updates and last field of each element."""
    return writes.groupBy("project", "path").agg(
        F.min("written_at").alias("created"),
        F.max("written_at").alias("updated"),
        F.count(F.lit(1)).alias("update_count"),
        F.max_by("field", F.struct("written_at", "seq")).alias("last_field"),
    )


def last_run_age(runs: DataFrame, now, overdue_minutes: int = 60) -> DataFrame:
    """Latest analysis run (project, run_at) of each project, its age, and whether it is overdue."""
    age = F.timestamp_diff("MINUTE", F.col("last_run"), F.lit(now).cast("timestamp"))
    return (
        runs.groupBy("project")
        .agg(F.max("run_at").alias("last_run"))
        .select("project", "last_run", age.alias("age_minutes"), (age > overdue_minutes).alias("overdue"))
    )
