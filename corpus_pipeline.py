"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` stores
every stage's result as Parquet in the shared folder and reads it again for the
next.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.llm.bpe import bpe_round_trip
from arborist.llm.common import fresh, from_files, locator
from arborist.llm.curriculum import curriculum_mix, training_order
from arborist.llm.exact_dedup import exact_dedup
from arborist.llm.jaccard import jaccard_join
from arborist.llm.quality import classify, quality_model
from arborist.session import configure, cut_lineage

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, doesn't reject.

    Null and empty texts have a score as well; repeated rows and ids are judged
    each by its text; labels of ids that no document has teach nothing.  Columns
    of any name are kept as they are, and an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    (predicted,) = fresh(docs, "predicted")
    return classify(docs, quality_model(docs, labels)).where(F.col(predicted) == 1).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id.

    Null counts as empty; of rows with the same text and id one stays; a null id
    is below every other.  Columns of any name are kept, and an empty table stays empty.
    """
    (kept,) = fresh(docs, "kept")
    return exact_dedup(docs).where(F.col(kept)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five words, 0.8): the one with the smallest id.

    Documents without words, null and empty ones included, are similar to nothing
    and stay; a null id is above every other; of rows that repeat an id and a text
    one stays.  Columns of any name are kept, and an empty table stays empty.
    """
    docs = from_files(docs)
    (place,) = fresh(docs, "_place")
    placed = docs.withColumn(place, locator())
    found = jaccard_join(placed.select("doc_id", "text", place), width=5, num=80, den=100, carry=[place])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", place)).alias("first")
    kept = found.where("component_key is not null").groupBy("component_key").agg(first).select(f"first.{place}")
    kept = kept.unionByName(found.where("component_key is null").select(place))
    return placed.join(kept, place, "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    Null and empty texts have no words and are never taken; a null source is a
    source of its own; repeated rows are documents of their own.  Columns of any
    name are kept, and an empty table stays empty.
    """
    return training_order(curriculum_mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the bytes that they decode to.

    A null text is an empty one, which has no ids; every row gives a row; other
    columns than doc_id, lang and source are left out; an empty table stays empty.
    """
    path = public_tokenizers.path(RANKS)
    coded = bpe_round_trip(docs, path, public_tokenizers.PATTERN, ("n_tokens", "ids", "decoded_sha256"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


def _configured(stage):
    """A stage that runs under the library's session settings, whoever calls it."""
    return lambda spark, docs, sf_dir: stage(configure(spark), docs, sf_dir)


STAGES = [
    (name, _configured(stage))
    for name, stage in (("quality", quality), ("exact_dedup", dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode))
]

#: The classifier is not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to `documents`."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
