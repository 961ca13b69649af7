"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.session import cut_lineage, drop_path, scratch

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of `df`: `names`, behind as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def from_files(df: DataFrame) -> DataFrame:
    """`df` itself when its rows come straight from files, else a stored copy of it.

    Rows of the result have `_metadata`, so (file_path, row_index) locates each
    of them for good, also when a lost task runs again.
    """
    try:
        df.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
        return df
    except AnalysisException:
        return cut_lineage(df)


def locator() -> Column:
    """Where a row of a file-backed table is: file and row number, as one string."""
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def give_back() -> None:
    """Return freed memory of a Python worker to the system; idle workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, component), component being the smallest node reached.

    Alternates two steps until nothing changes: every node joins its larger
    neighbours to the smallest node it sees, then its smaller neighbours and
    itself to the smallest (star contraction).  The number of rounds grows with
    the logarithm of the longest path.  A round is two pre-aggregated groupings
    and two joins of thin rows, written to the shared folder; the superseded
    round is deleted.  Nodes without an edge to another node have no row.
    """
    spark = edges.sparkSession
    one, two = F.col(a).alias("u"), F.col(b).alias("v")
    current = edges.select(one, two).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    path = scratch(spark, "edges")
    current.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().write.parquet(path)
    schema = current.schema
    before = None
    while True:
        e = spark.read.schema(schema).parquet(path)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(floor, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        after = scratch(spark, "edges")
        small.write.parquet(after)
        now = spark.read.schema(schema).parquet(after)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        path = after
        if before == tuple(state):
            break
        before = tuple(state)
    stars = spark.read.schema(schema).parquet(path)
    return (
        stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )
