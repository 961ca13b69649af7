"""Mixing sources to target weights along a time-varying curriculum.

A source has a weight schedule over training time 0..1.  Its integral says how
many of the source's words are due by any time; inverting that cumulative
demand gives each document the time at which its words fall due.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborist.llm.common import fresh, word_count

#: Weight schedules by weight class: knots (time, weight), linear in between.
SCHEDULES: dict[int, list[tuple[float, float]]] = {
    1: [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)],
    2: [(0.0, 1.0), (1.0, 1.0)],
    3: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)],
}


def due_time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which `share` (0..1) of a source's words is due: the inverse of the integrated schedule.

    The weight is linear within a segment, so its integral is a quadratic
    there, inverted in closed form.
    """
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total = sum(areas)
    need, out, done = share * F.lit(total), F.lit(None).cast("double"), 0.0
    for k in range(len(areas)):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        slope = (w1 - w0) / (t1 - t0)
        rest = F.greatest(need - F.lit(done), F.lit(0.0))
        if slope == 0:
            step = rest / F.lit(w0)
        else:
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
            step = F.lit(2.0) * rest / (F.lit(w0) + root)
        done += areas[k]
        here = F.lit(t0) + F.least(step, F.lit(t1 - t0))
        inside = F.lit(True) if k == len(areas) - 1 else need < F.lit(done)
        out = F.coalesce(out, F.when(inside, here))
    return F.coalesce(out, F.lit(0.0))


def source_targets(sources: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Targets of (source, source_size, rows): weights 1, 2, 3 repeating in code point order, null last.

    All sizes are shared by weight; a target stops at `max_repeats` times its
    source's size and the excess is shared again by weight.  In closed form:
    with sources ordered by cap per unit of weight, the first k are at their
    cap and the others share the rest at one rate, k being the least for which
    no further source is above; capping more would only lower the rate, so it
    is the largest rate that fits.  One row per source passes through one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    capped = ranked.withColumn("cap", F.col("source_size") * max_repeats)
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").isNull(), "source")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rates = capped.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "caps_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weights_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("rate", (F.col("total") - F.col("caps_before")) / F.col("weights_left"))
    fits = F.when(ratio >= F.col("rate"), F.col("rate"))
    return rates.withColumn("level", F.max(fits).over(everything)).select(
        "source", "source_size", "rows", "weight", "total", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def curriculum_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
    max_repeats: int = 3,
    rows_per_cell: int = 2000,
    schedules: Mapping[int, Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """All rows of `docs` with size, source_size, target, copies, taken and positions, range-sorted by first position.

    Size is the number of words (null text: 0).  A source whose target is r
    times its size gives every document floor(r) copies, and one more to the
    documents that come first in a seeded order, up to the nearest document
    end.  `positions` holds each copy's training time, ascending; a document
    that is not taken has none and comes last.  Rows repeating an id are rows
    of their own; null ids and null sources are a value like any other.  An
    empty table gives an empty result.  Added columns that clash with one of
    `docs` get a leading underscore.

    The seeded order is cut into cells of about `rows_per_cell` rows by its
    hash, so running sums need no group larger than a cell, however much of the
    data one source holds.
    """
    size, src_size, target, copies, taken, positions = fresh(
        docs, "size", "source_size", "target", "copies", "taken", "positions"
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    base = docs.withColumns({size: word_count(F.col(text_col)), "_key": key, "_src": F.col(source_col)})
    sources = base.groupBy("_src").agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = source_targets(sources.withColumnRenamed("_src", "source"), max_repeats)
    cells = F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.lit(rows_per_cell)))
    t = targets.select(
        F.col("source").alias("_t_src"), F.col("source_size").alias(src_size), F.col("rows").alias("_rows"),
        F.col("weight").alias("_weight"), F.col("target").alias(target),
    )
    at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    placed = base.join(t, F.col("_src").eqNullSafe(F.col("_t_src"))).withColumn("_cell", F.floor(at * cells / F.lit(1 << 32)))
    inner = Window.partitionBy("_src", "_cell").orderBy("_key", id_col, size).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_src", "_cell").agg(F.sum(size).alias("_cell_size"))
    past = Window.partitionBy("_src").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        F.col("_src").alias("_o_src"), F.col("_cell").alias("_o_cell"), F.coalesce(F.sum("_cell_size").over(past), F.lit(0)).alias("_offset")
    )
    summed = placed.withColumn("_within", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(
        offsets, F.col("_src").eqNullSafe(F.col("_o_src")) & (F.col("_cell") == F.col("_o_cell"))
    )
    start = F.col("_offset") + F.col("_within")
    whole = F.when(F.col(src_size) > 0, F.floor(F.col(target) / F.col(src_size))).otherwise(F.lit(0)).cast("long")
    extra = (start * 2 + F.col(size) <= (F.col(target) - F.col("_whole") * F.col(src_size)) * 2) & (F.col("_whole") < max_repeats)
    counted = summed.withColumns({"_start": start, "_whole": whole}).withColumn(
        copies, F.when(F.col(size) > 0, F.col("_whole") + extra.cast("long")).otherwise(F.lit(0)).cast("int")
    )

    def moment(copy: Column) -> Column:
        share = F.least(F.lit(1.0), (copy * F.col(src_size) + F.col("_start")) / F.col(target))
        out = F.lit(None).cast("double")
        for weight, knots in schedules.items():
            out = F.when(F.col("_weight") == weight, due_time(share, knots)).otherwise(out)
        return out

    times = F.filter(F.array(*[F.when(F.lit(k) < F.col(copies), moment(F.lit(k))) for k in range(max_repeats)]), lambda x: x.isNotNull())
    mixed = counted.withColumns({taken: F.col(size) * F.col(copies), positions: times})
    first = F.coalesce(F.get(F.col(positions), 0), F.lit(2.0))
    return mixed.orderBy(first, F.col(source_col), "_key", id_col).select(*docs.columns, size, src_size, target, copies, taken, positions)


def training_order(mixed: DataFrame, positions: str = "positions") -> DataFrame:
    """One row per copy of each document taken, with its `position`, range-sorted by it."""
    (position,) = fresh(mixed, "position")
    return mixed.withColumn(position, F.explode(positions)).orderBy(position)
