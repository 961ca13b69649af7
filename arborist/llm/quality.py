"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and
a diagonal.  The Cholesky factors of the covariances are computed once; a score
is the logistic of the difference of the two log densities, whose Mahalanobis
distances are solved with those factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborist.llm.common import fresh, give_back

STATISTICS = [
    "log_words", "vocabulary_exponent", "log_word_length", "inner_upper_share", "symbol_share", "digit_share",
    "stops_per_word", "commas_per_word", "log_words_per_line", "repeated_line_share", "long_word_share",
]

_DIGIT = np.arange(ord("0"), ord("9") + 1)
_IS_UPPER = np.array([chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in range(256)])
_IS_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_SYMBOL = np.array([b for b in range(33, 127) if chr(b) not in ".,'-" and not chr(b).isalnum()])


def statistics(text: str) -> tuple[float, ...]:
    """Transformed statistics of one whole text: logs of counts, square roots of shares.

    Shares have a constant added below, so that a text of a few words can't reach an extreme one.
    """
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    size = int(counts.sum())
    lines = [line for line in text.split("\n") if line.strip()]
    inner = _IS_LETTER[raw[:-1]]
    inner_upper = int((inner & _IS_UPPER[raw[1:]]).sum())
    spread = np.log1p(len(set(words))) / np.log1p(n) if n else 1.0
    return (
        float(np.log1p(n)),
        float(spread),
        float(np.log1p((size - counts[32] - counts[10]) / max(1, n))),
        float(np.sqrt(inner_upper / (int(inner.sum()) + 20))),
        float(np.sqrt(counts[_SYMBOL].sum() / (size + 20))),
        float(np.sqrt(counts[_DIGIT].sum() / (size + 20))),
        float(np.sqrt(counts[46] / (n + 8))),
        float(np.sqrt(counts[44] / (n + 8))),
        float(np.log1p(n / max(1, len(lines)))),
        float(np.sqrt(1 - len(set(lines)) / max(1, len(lines)))),
        float(np.sqrt(sum(len(w) > 15 for w in words) / (n + 8))),
    )


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of `docs` (default: all) and `features`, an array of the statistics; null text counts as empty."""
    kept = docs.columns if keep is None else keep
    (name,) = fresh(docs.select(*kept), "features")
    fields = [docs.schema[c] for c in kept]
    source = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_statistics_text"))
    columns = [*kept, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(columns) - 1).to_pylist()
            values = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=columns)
        give_back()

    return source.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log densities' constants of class 0 and class 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """log p(1|x) - log p(0|x) of rows of statistics."""
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            z = (x - mean) @ factor.T
            logs.append(constant - 0.5 * np.einsum("ij,ij->i", z, z))
        return logs[1] - logs[0]


def fit(labelled: DataFrame, label: str, features: str = "features", shrinkage: float = 0.05, ridge: float = 1e-4) -> Discriminant | None:
    """Fit on all labelled rows; labels other than 0 and 1 are left out.

    Spark sums counts, statistics and their products per class, combined
    before the shuffle; two rows reach the driver.  Returns None unless both
    classes have rows.
    """
    d = len(STATISTICS)
    x = [F.get(F.col(features), k) for k in range(d)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()
    by_class = {r[label]: r for r in rows}
    if set(by_class) != {0, 1}:
        return None
    counts, means, scatters = [], [], []
    for c in (0, 1):
        r = by_class[c]
        n = r["n"]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / n
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                second[i, j] = second[j, i] = r[f"p{i}_{j}"]
        counts.append(n)
        means.append(mean)
        scatters.append(second - n * np.outer(mean, mean))
    pooled = (scatters[0] + scatters[1]) / sum(counts)
    factors, constants = [], []
    for n, scatter in zip(counts, scatters, strict=True):
        own = shrinkage + (1 - shrinkage) * d / (d + n)  # few rows lean on the pooled covariance
        cov = (1 - own) * scatter / n + own * pooled
        cov += ridge * (np.diag(np.diag(pooled)) + np.eye(d))
        lower = np.linalg.cholesky((cov + cov.T) / 2)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n / sum(counts)) - np.log(np.diag(lower)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(constants))


def score(stats: DataFrame, model: Discriminant | None, features: str = "features") -> DataFrame:
    """`stats` with `score` in place of its features: probability of class 1, 0.5 where there is no model."""
    kept = [c for c in stats.columns if c != features]
    (name,) = fresh(stats.select(*kept), "score")
    columns = [*kept, name]
    if model is None:
        return stats.select(*kept, F.lit(0.5).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            p = 1 / (1 + np.exp(-np.clip(model.log_odds(x), -700, 700))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=columns)

    schema = T.StructType([*(stats.schema[c] for c in kept), T.StructField(name, T.DoubleType())])
    return stats.select(*kept, features).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", text_col: str = "text") -> Discriminant | None:
    """Learn `label` from the rows of `docs` that have one and are not held out.

    Rows repeated in either table count as often as they match.  Null ids and
    null labels teach nothing.
    """
    own = labels.select(F.col(id_col), F.col(label).cast("int").alias("_label")).where(F.col("_label").isNotNull() & F.col(id_col).isNotNull())
    train = with_statistics(docs.where(~held_out(F.col(id_col))), text_col, [id_col])
    return fit(train.join(own, id_col), "_label")


def classify(docs: DataFrame, model: Discriminant | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of `docs` (default: all) with `score` and `predicted` (1 from 0.5 on); empty and null texts too.

    Nothing but the text enters a score.  There is no shuffle.  An added column
    that clashes with a kept one gets a leading underscore.
    """
    stats = with_statistics(docs, text_col, keep)
    scored = score(stats, model, stats.columns[-1])
    (predicted,) = fresh(scored, "predicted")
    return scored.withColumn(predicted, (F.col(scored.columns[-1]) >= 0.5).cast("int"))
