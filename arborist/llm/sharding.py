"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit in memory, by a
seeded hash.  Pass two shuffles each bucket (Fisher-Yates) and writes it.  The
buckets follow one another in the shuffled order, which is cut into shards of
equal row counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborist.llm.common import fresh
from arborist.session import cut_lineage

BUCKET_BYTES = 16 << 20


def record_bytes(text: Column) -> Column:
    """Size of a record: UTF-8 bytes of its text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n), the same for the same seed and bucket."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = np.arange(n)
    picks = (rng.random(max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int64)
    for i, j in zip(range(n - 1, 0, -1), picks.tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows of `docs` with size, shard and slot; shards' row counts differ by at most one.

    A bucket's place in the whole order is the number of rows in the buckets
    before it, which a pre-aggregated count gives: one row per bucket.  Slots
    run from 0 without gaps in each shard.  The order depends on the seed and
    the rows alone: within a bucket rows are put in the order of a second hash
    before they are permuted.  Null ids and null texts are values like any
    other (a null text has size 1), equal rows land in one bucket, copies with
    ids of their own are spread, and an empty table gives an empty result.  An
    added column that clashes with one of `docs` gets a leading underscore.
    """
    size, shard, slot, bucket, mix = fresh(docs, "size", "shard", "slot", "_bucket", "_mix")
    total = docs.agg(F.sum(record_bytes(F.col(text_col)))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    scatter = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    scattered = docs.withColumns(
        {size: record_bytes(F.col(text_col)), bucket: F.pmod(scatter, F.lit(buckets)), mix: F.xxhash64(F.lit(~seed), F.col(id_col), F.col(text_col))}
    )
    counts = scattered.groupBy(bucket).agg(F.count(F.lit(1)).alias("_rows"))
    past = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # stored, so that the join is planned from the size of a row per bucket and no text is shuffled for it
    places = cut_lineage(
        counts.withColumnRenamed(bucket, "_b").select(
            "_b", F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_first"), F.sum("_rows").over(everything).alias("_all")
        )
    )
    schema = T.StructType([*scattered.schema.fields, T.StructField("_slot", T.LongType())])

    def shuffle(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(tables))
        number = table[bucket][0].as_py()
        order = np.argsort(table[mix].to_numpy(), kind="stable")[fisher_yates(table.num_rows, seed, number)]
        table = table.take(pa.array(order)).append_column("_slot", pa.array(np.arange(table.num_rows)))
        yield from table.to_batches(max_chunksize=2000)

    shuffled = scattered.groupBy(bucket).applyInArrow(lambda t: pa.Table.from_batches(shuffle(t.to_batches())), schema)
    at = F.col("_first") + F.col("_slot")
    cut = lambda k: F.floor((k * F.col("_all") + F.lit(shards - 1)) / F.lit(shards))  # noqa: E731  first position of shard k
    found = F.floor(at * shards / F.col("_all"))
    return (
        shuffled.join(places, F.col(bucket) == F.col("_b"))
        .withColumn(shard, found.cast("int"))
        .withColumn(slot, (at - cut(F.col(shard))).cast("long"))
        .select(*docs.columns, size, shard, slot)
    )


def write_shards(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """Write the shards as folders `shard=k`; buckets keep their order in the slots of the rows."""
    sharded.write.option("compression", "zstd").partitionBy(shard).parquet(path)
