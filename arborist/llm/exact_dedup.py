"""Exact deduplication by a stateful stream.

The state of the stream is keyed by content digest, lives on disk (RocksDB),
and never expires.  Per digest it keeps the stable identifier of the row that
stays, the locator of that row's content and the number of copies seen.  Equal
digests are hits; their full bytes are compared before they count as copies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import fresh, from_files, locator
from arborist.session import cut_lineage, scratch

#: State on disk, without preallocated files: a store per partition stays as small as its keys;
#: a batch uploads its changes only.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


FEED = "digest BINARY, id LONG, locator STRING"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keeper_state(stream: DataFrame) -> DataFrame:
    """Stateful operator: (digest, id, locator) rows to one running row per digest.

    The largest id stays, ties go to the largest locator.  Spark combines the
    rows of a task before the shuffle, so a digest that holds a third of all
    rows sends one row per task.
    """
    return stream.groupBy("digest").agg(
        F.max(F.struct("id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size")
    )


def drain(folder: str, spark, batches: int = 4) -> DataFrame:
    """Run the stream over the feed files that it hasn't seen, and return the state: one row per digest.

    The feed comes in several micro-batches, so later rows meet the state of
    earlier ones.  Each batch writes the digests it changed to a folder of its
    own, overwriting it when the batch is run again after a failure.  Feed, state
    and progress are in `folder` in the shared storage: a lost executor or driver
    resumes, and a later run goes on with the state where new files were fed.
    """
    session = spark.newSession()
    for key, value in STATE_CONF.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.schema(FEED).parquet(f"{folder}/feed").select("_metadata.file_path").distinct().count()
    reader = session.readStream.schema(FEED).option("maxFilesPerTrigger", max(1, -(-files // batches)))
    out = f"{folder}/state"

    def save(batch: DataFrame, epoch: int) -> None:
        batch.select("digest", "keeper.id", "keeper.locator", "group_size").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (
        keeper_state(reader.parquet(f"{folder}/feed"))
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    schema = "digest BINARY, id LONG, locator STRING, group_size LONG, epoch INT"
    states = spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(out)
    latest = F.max(F.struct("group_size", "id", "locator")).alias("s")  # sizes only grow
    return states.groupBy("digest").agg(latest).select("digest", "s.id", "s.locator", "s.group_size")


def feed_new(keyed: DataFrame, folder: str, batches: int) -> None:
    """Add to the feed what it doesn't hold: rows (digest, id, locator) of files that weren't fed before."""
    spark = keyed.sparkSession
    path = f"{folder}/feed"
    partitions = keyed.rdd.getNumPartitions()  # of a scan: nothing runs
    of_file = F.substring_index("locator", "#", 1)
    try:
        fed = spark.read.schema(FEED).parquet(path).select(of_file.alias("file")).distinct()
        keyed = keyed.join(fed, of_file == F.col("file"), "left_anti")
    except AnalysisException:  # the first run: there is no feed
        pass
    (keyed if partitions >= batches else keyed.repartition(batches)).write.mode("append").parquet(path)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    keep: Sequence[str] | None = None,
    folder: str | None = None,
    batches: int = 4,
) -> DataFrame:
    """All rows of `docs` with keep_id, keep_locator, group_size and kept.

    Texts are equal when their bytes are; null counts as empty.  The row with
    the largest id of a group stays (a null id is below every other; of rows
    with the same id and text exactly one stays).  An empty table gives an
    empty result.  Extra columns are carried along, or those named in `keep`;
    one named like an added column keeps its name and the added one gets a
    leading underscore.

    `folder` in the shared storage holds feed, state and progress.  Given again
    with a table that has gained files, it takes in the new ones only; without
    it, a run has a folder of its own.

    Hits are verified in full: of every digest that more than one row has, the
    smallest and the largest text are found with a combine before the shuffle,
    and where they differ the digest's rows are grouped anew by their bytes.
    """
    spark = docs.sparkSession
    docs = from_files(docs)
    keep = list(docs.columns if keep is None else keep)
    keep_id, keep_locator, size, kept, d, loc, t, k = fresh(docs, "keep_id", "keep_locator", "group_size", "kept", "_d", "_l", "_t", "_k")
    folder = folder or scratch(spark, "dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    identifier = F.col(id_col).cast("long")
    keyed = docs.withColumns({d: digest(text), loc: locator()})
    feed_new(keyed.select(F.col(d).alias("digest"), identifier.alias("id"), F.col(loc).alias("locator")), folder, batches)
    state = cut_lineage(drain(folder, spark, batches))

    hits = cut_lineage(state.where("group_size > 1").select(F.col("digest").alias(d)))
    # the hits grow with the data: they are shuffled at every size, never broadcast
    bytes_of = keyed.join(hits.hint("merge"), d, "left_semi").groupBy(d).agg(F.min(text).alias("lo"), F.max(text).alias("hi"))
    mixed = cut_lineage(bytes_of.where("lo != hi").select(d))
    found = state.select(F.col("digest").alias(d), F.col("id").alias(keep_id), F.col("locator").alias(keep_locator), F.col("group_size").alias(size))
    found = found.hint("merge")
    thin = keyed.select(*dict.fromkeys([*keep, d, loc]))
    stays = F.col(loc) == F.col(keep_locator)
    if mixed.isEmpty():
        return thin.join(found, d).select(*keep, keep_id, keep_locator, size, stays.alias(kept))
    collided = keyed.withColumn(t, text).join(mixed, d, "left_semi")
    groups = collided.groupBy(d, t).agg(F.max(F.struct(identifier.alias("id"), F.col(loc).alias("locator"))).alias(k), F.count(F.lit(1)).alias(size))
    split = collided.join(groups, [d, t]).withColumns({keep_id: F.col(f"{k}.id"), keep_locator: F.col(f"{k}.locator")})
    plain = thin.join(mixed, d, "left_anti").join(found, d)
    columns = [*keep, keep_id, keep_locator, size, stays.alias(kept)]
    return plain.select(*columns).unionByName(split.select(*columns))
