"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def half_up(c: Column) -> Column:
    """Round half up to an integer."""
    return F.floor(c + 0.5)


def half_up2(c: Column) -> Column:
    """Round half up to two decimals."""
    return F.floor(c * 100 + 0.5) / 100


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First `n` rows of each group.

    Spark turns the rank filter into a group limit below the shuffle, so a hot
    group sends at most `n` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return ranked.withColumnRenamed("_rn", rank) if rank else ranked.drop("_rn")


def count_rows(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def paginate(df: DataFrame, order: Sequence[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of a result; the limit is clamped to 1..50 as the search API does."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(50, limit)))
