"""Iterative graph jobs: reachability, paths, cycles, components, communities, order.

Each round is a join over the edge table whose result is appended to one folder
of the shared storage and read back, so a plan holds one scan of what has been
reached whatever the round, and a lost executor re-reads files.  Where rounds are
many and the graph is large, files are numbers, and steps and levels are stored
in buckets, so a round moves its frontier only.  Tables that a round replaces are deleted.  The only thing the driver looks at is whether a
round's table is empty.

Most projects are small, so jobs that take `small` work on projects of up to so
many rows without rounds: one shuffle brings a project together, and a task
works on it whole (`projects`).  Rounds are for the others, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborist.functions.common import count_rows, half_up2, top_n
from arborist.operators import projects
from arborist.session import cut_lineage, drop_path, place, scratch
from arborist.sources.sinks import number_rows


class _Levels:
    """Tables of one schema, appended level by level to one folder and read as one table with a `level` column.

    With `keys`, the levels are in buckets of these: a join or grouping by them moves no row of what is stored.
    """

    def __init__(self, spark: SparkSession, schema: str, keys: list[str] | None = None):
        self.spark, self.schema, self.keys, self.path, self.count = spark, schema, keys, scratch(spark, "levels"), 0
        self.table = ""

    def add(self, df: DataFrame) -> DataFrame:
        """Store a level (numbered from 1) and return it as stored."""
        self.count += 1
        if self.keys:
            self.table = place(df.withColumn("level", F.lit(self.count)), self.keys, self.table, "level")
            return self.all().where(F.col("level") == self.count).drop("level")
        path = f"{self.path}/level={self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.table(self.table) if self.keys else self.spark.read.schema(self.schema).parquet(self.path)


class _Latest:
    """A table that each round replaces; the one before is deleted."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, ""
        self.put(df)

    def put(self, df: DataFrame) -> DataFrame:
        old, self.path = self.path, scratch(self.spark, "round")
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if old:
            drop_path(self.spark, old)
        return self.df


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(project, a, b): a step of the walk; `reverse` walks from imported to importer."""
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    return edges.select("project", F.col(a).alias("a"), F.col(b).alias("b")).distinct()


# ---- small projects ---------------------------------------------------------------

#: Rows of a project that one task may work on.
SMALL = 65_536


#: Pairs times rows, for each row of the limit, that one task may search a way for; a path has no more files than there are rows.
SEARCHED = 64


def _by_size(rows: DataFrame, small: int, asked: str = "false") -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of projects with at most `small` of them, and those of larger projects; None for what is known to be empty.

    `asked` are the rows that each take a search of the project.
    """
    rows = rows.where("project IS NOT NULL")
    if not small:
        return None, rows
    size = rows.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(asked)).alias("searches"))
    large = cut_lineage(size.where((F.col("n") > small) | (F.col("n") * F.col("searches") > small * SEARCHED)).select("project"))
    if large.isEmpty():
        return rows, None
    return rows.join(large, "project", "left_anti"), rows.join(large, "project", "left_semi")


def _whole(rows: DataFrame, work: Callable[..., pa.Table], schema: str, **settings: float) -> DataFrame:
    """`work` on the rows of each project."""

    def task(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return work(key, table, **settings)

    return rows.groupBy("project").applyInArrow(task, schema)


# ---- numbers for names ------------------------------------------------------------


def _id(project: str, node: str, seed: int) -> Column:
    return F.xxhash64(project, node, F.lit(seed))


def _number(edges: DataFrame) -> tuple[int, DataFrame]:
    """A seed of a hash that differs between all files of `edges`, and each file's (project, node, id).

    Rounds then move numbers instead of names.  Two files of one hash are looked for, and another seed is taken if there are any.
    """
    ends = edges.select("project", F.explode(F.array("src", "dst")).alias("node")).dropna().distinct()
    for seed in count():
        names = cut_lineage(ends.select("project", "node", _id("project", "node", seed).alias("id")))
        if count_rows(names, "id").where("n > 1").isEmpty():
            return seed, names
    raise AssertionError("seeds do not end")


def _numbered_steps(edges: DataFrame, direction: str, seed: int) -> DataFrame:
    """(project, a, b): `directed` between numbers, with its repeated rows."""
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    named = edges.select("project", "src", "dst").dropna()
    return named.select("project", _id("project", a, seed).alias("a"), _id("project", b, seed).alias("b"))


def _placed(steps: DataFrame) -> DataFrame:
    """Different steps, in buckets of where they start, so that no round moves them."""
    return steps.sparkSession.table(place(steps.repartition("a").distinct(), ["a"]))


def _reached(steps: DataFrame, start: DataFrame) -> DataFrame:
    """(node, root) of all that placed `steps` reach from `start` (node, root), in buckets of node; a node is met by one root only.

    The start is not marked, so it comes back iff it lies on a cycle.
    """
    seen = _Levels(steps.sparkSession, "node LONG, root LONG", ["node"])
    frontier = start
    while True:
        ahead = frontier.select(F.col("node").alias("a"), "root").hint("shuffle_hash").join(steps.select("a", "b"), "a")
        met = ahead.groupBy(F.col("b").alias("node")).agg(F.min("root").alias("root"))
        frontier = seen.add(met.join(seen.all().select("node"), "node", "left_anti") if seen.count else met)
        if frontier.isEmpty():
            return seen.all().select("node", "root")


def _spread(steps: DataFrame, start: DataFrame, keys: list[str], max_depth: int | None) -> DataFrame:
    """Level-synchronous search; `start` has keys + node.  Returns keys, node, depth >= 1.

    The start is not marked, so it comes back iff it lies on a cycle.
    """
    columns = [*keys, "node"]
    seen = _Levels(start.sparkSession, ", ".join(f"`{c}` STRING" for c in columns))
    frontier = start.select(*keys, F.col("node").alias("a"))
    while max_depth is None or seen.count < max_depth:
        reached = frontier.join(steps, ["project", "a"]).select(*keys, F.col("b").alias("node")).distinct()
        if seen.count:
            reached = reached.join(seen.all().select(*columns), columns, "left_anti")
        level = seen.add(reached)
        if level.isEmpty():
            break
        frontier = level.select(*keys, F.col("node").alias("a"))
    if not seen.count:
        return start.select(*columns, F.lit(0).alias("depth")).where(F.lit(False))
    return seen.all().select(*columns, F.col("level").cast("int").alias("depth"))


#: Seeds in a word of a node's bitmap.
WORD_BITS = 64


def _bits(steps: DataFrame, start: DataFrame, max_depth: int | None) -> _Levels | None:
    """Level-synchronous search from many seeds at once: (node, word, project, bits) of what each level reaches anew.

    `start` has project, number (of the seed, within its project) and node.  A
    node holds a bitmap of the seeds that reach it, a row for each 64 of them;
    a round joins the new bits to the placed steps, ORs what meets, and leaves
    out the bits that are known, which stay where they are stored.  Its rows are
    nodes and words, whatever the number of pairs.  The start is not marked, so it comes back iff it lies on a cycle.
    """
    keys = ["node", "word", "project"]
    found = _Levels(start.sparkSession, "node LONG, word LONG, project STRING, bits LONG", keys)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("number", F.lit(WORD_BITS)).cast("int"))
    word = F.floor(F.col("number") / WORD_BITS)
    frontier = start.select("node", word.alias("word"), "project", bit.alias("bits")).groupBy(*keys).agg(F.bit_or("bits").alias("bits"))
    while max_depth is None or found.count < max_depth:
        ahead = frontier.select(F.col("node").alias("a"), "word", "project", "bits").hint("shuffle_hash").join(steps.select("a", "b"), "a")
        new = ahead.groupBy(F.col("b").alias("node"), "word", "project").agg(F.bit_or("bits").alias("bits"))
        if found.count:
            known = new.join(found.all().select(*keys, F.col("bits").alias("known")), keys, "left")
            both = known.groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.bit_or("known").alias("known"))
            fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
            new = both.select(*keys, fresh.alias("bits")).where("bits <> 0")
        frontier = found.add(new)
        if frontier.isEmpty():
            break
    return found if found.count else None


def _numbers(word: Column, bits: Column) -> Column:
    """The seed numbers that a bitmap row holds, as an array."""
    at = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))
    held = F.filter(at, lambda i: F.call_function("shiftrightunsigned", bits, i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.transform(held, lambda i: word * WORD_BITS + i)


def _seed_levels(edges: DataFrame, seeds: DataFrame, direction: str, max_depth: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names (project, node, id), numbered seeds (project, seed, number, id), and (project, id, word, bits, depth) of all that they reach."""
    seed, names = _number(edges)
    numbered = number_rows(seeds.select("project", "seed").distinct(), "project", ["seed"], "number")
    numbered = cut_lineage(numbered.withColumn("id", _id("project", "seed", seed)))
    # a seed without edges has no number of its own, and might have that of another file
    start = numbered.join(names.select("project", F.col("node").alias("seed")), ["project", "seed"], "left_semi")
    steps = _placed(_numbered_steps(edges, direction, seed).select("a", "b"))
    found = _bits(steps, start.select("project", "number", F.col("id").alias("node")), max_depth)
    if found is None:
        none = numbered.select("project", "id", F.lit(0).cast("long").alias("word"), F.lit(0).cast("long").alias("bits"), F.lit(0).alias("depth"))
        return names, numbered, none.where(F.lit(False))
    return names, numbered, found.all().select("project", F.col("node").alias("id"), "word", "bits", F.col("level").alias("depth"))


def closure(
    edges: DataFrame, seeds: DataFrame, direction: str = "forward", max_depth: int | None = None
) -> DataFrame:
    """Everything reachable from each seed (project, seed) with its least depth."""
    names, numbered, reached = _seed_levels(edges, seeds, direction, max_depth)
    named = reached.join(names.select("id", "node"), "id")
    each = named.select("project", "node", "depth", F.explode(_numbers(F.col("word"), F.col("bits"))).alias("number"))
    return each.join(numbered.drop("id"), ["project", "number"]).select("project", "seed", "node", "depth")


def transitive_dependents(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(edges, seeds, "reverse")


def transitive_dependencies(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(edges, seeds, "forward")


def change_impact(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Direct, transitive and total importers of each target (project, seed), and the depth."""
    _, numbered, reached = _seed_levels(edges, targets, "reverse", None)
    # files of one level and the same targets are counted before they are told apart by target
    alike = count_rows(reached, "project", "depth", "word", "bits").select(
        "project", "depth", "n", F.explode(_numbers(F.col("word"), F.col("bits"))).alias("number")
    )
    # a target that reaches itself is not one of its importers
    own = reached.join(numbered.select("id", "number"), "id").where(F.array_contains(_numbers(F.col("word"), F.col("bits")), F.col("number")))
    hit = alike.unionByName(own.select("project", "depth", F.lit(-1).cast("long").alias("n"), "number"))
    levels = hit.groupBy("project", "number", "depth").agg(F.sum("n").alias("n")).where("n > 0")
    per = levels.groupBy("project", "number").agg(
        F.sum(F.when(F.col("depth") == 1, F.col("n")).otherwise(0)).alias("direct"),
        F.sum(F.when(F.col("depth") > 1, F.col("n")).otherwise(0)).alias("transitive"),
        F.max("depth").alias("impact_depth"),
        F.sum("n").alias("total_affected"),
    )
    return (
        numbered.join(per, ["project", "number"], "left")
        .drop("number", "id")
        .fillna(0, ["direct", "transitive", "impact_depth", "total_affected"])
    )


def change_set_impact(edges: DataFrame, change_set: DataFrame) -> DataFrame:
    """Files affected by a whole change set (project, seed): changed, affected besides, depth."""
    changed = change_set.select("project", F.col("seed").alias("node")).distinct()
    steps = cut_lineage(directed(edges, "reverse"))
    hit = _spread(steps, changed, ["project"], None).join(changed, ["project", "node"], "left_anti")
    per = hit.groupBy("project").agg(F.count(F.lit(1)).alias("total_affected"))
    return (
        count_rows(changed, "project", name="changed_files")
        .join(per, "project", "left")
        .fillna(0, ["total_affected"])
    )


def affected_files(edges: DataFrame, changed: DataFrame, depth: int = 5) -> DataFrame:
    """Changed files (project, file) and everything importing them within `depth` steps."""
    start = changed.select("project", F.col("file").alias("node")).distinct()
    steps = cut_lineage(directed(edges, "reverse"))
    hit = _spread(steps, start, ["project"], depth).join(start, ["project", "node"], "left_anti")
    return (
        start.withColumn("depth", F.lit(0)).unionByName(hit).select("project", F.col("node").alias("file"), "depth")
    )


# ---- paths ------------------------------------------------------------------


def _least_paths(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project, src, dst, path): for each wanted pair with a way, the fewest edges, then the least path.

    The search goes backwards from the ends, so pairs that share an end share
    its tree.  A level holds, for every end and node reached anew, the node
    after it on the least way: the least of those one level nearer to the end.
    No path is stored: those that are wanted are unwound from their starts.  An
    end goes no further once all its wanted starts are reached.
    """
    keys = ["project", "dst"]
    columns = [*keys, "node"]
    seen = _Levels(steps.sparkSession, "project STRING, dst STRING, node STRING, after STRING")
    null = F.lit(None).cast("string")
    aims = cut_lineage(wanted.where("src <> dst").select("project", "dst", F.col("src").alias("node")).distinct())
    ends = aims.select("project", "dst").distinct()
    frontier = seen.add(ends.select("project", "dst", F.col("dst").alias("node"), null.alias("after")))
    left = _Latest(aims)
    while not frontier.isEmpty():
        going = frontier.join(left.df.select(*keys).distinct(), keys, "left_semi")
        nxt = (
            going.select(*keys, F.col("node").alias("b"))
            .join(steps, ["project", "b"])
            .groupBy(*keys, F.col("a").alias("node"))
            .agg(F.min("b").alias("after"))
            .join(seen.all().select(*columns), columns, "left_anti")
        )
        frontier = seen.add(nxt)
        left.put(left.df.join(frontier, columns, "left_anti"))
    found = seen.all()
    here = wanted.where("src = dst").select("project", "src", "dst", F.array("src").alias("path"))
    # unwind: what stands at a level is lengthened by its node, and goes on from the one after it with those that start there
    starts = cut_lineage(found.where("node <> dst").join(aims, columns, "left_semi").select(*columns, "level"))
    began = starts.select("level", *columns, F.col("node").alias("src"), F.array().cast("array<string>").alias("path"))
    walk = began.drop("level").where(F.lit(False))
    for level in range(seen.count, 1, -1):
        stand = found.where(F.col("level") == level).select(*columns, "after")
        longer = walk.unionByName(began.where(F.col("level") == level).drop("level")).join(stand, columns)
        walk = cut_lineage(longer.select(*keys, F.col("after").alias("node"), "src", F.concat("path", F.array("node")).alias("path")))
    done = walk.select("project", "src", "dst", F.concat("path", F.array("dst")).alias("path"))
    return here.unionByName(done)


def _least_ways(edges: DataFrame, pairs: DataFrame, small: int) -> DataFrame:
    """`_least_paths` of different `pairs` over `edges` (project, src, dst), in projects of up to `small` edges and pairs by a task each."""
    wanted = cut_lineage(pairs.select("project", "src", "dst").distinct())
    if not small:
        return _least_paths(cut_lineage(directed(edges, "forward")), wanted)
    here, apart = wanted.where("src = dst"), wanted.where("src <> dst")
    rows = edges.select("project", "src", "dst", F.lit(False).alias("asked")).dropna()
    whole, others = _by_size(rows.unionByName(apart.withColumn("asked", F.lit(True))), small, "asked")
    parts = [here.select("project", "src", "dst", F.array("src").alias("path"))]
    if whole is not None:
        parts.append(_whole(whole, projects.least_paths, "project STRING, src STRING, dst STRING, path ARRAY<STRING>"))
    if others is not None:
        steps = cut_lineage(directed(others.where("NOT asked"), "forward"))
        parts.append(_least_paths(steps, others.where("asked").select("project", "src", "dst")))
    return _union(parts)


def shortest_path(edges: DataFrame, pairs: DataFrame, small: int = 0) -> DataFrame:
    """One fewest-edge path per pair (project, src, dst); ties to the least path.

    Projects of up to `small` edges and pairs are searched whole.
    """
    found = _least_ways(edges, pairs, small)
    return found.select("project", "src", "dst", (F.size("path") - 1).alias("length"), F.array_join("path", " > ").alias("path"))


def _joined_pairs(steps: DataFrame, pairs: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of different files with a way of at most `max_depth` edges, and the steps between files that the search met.

    The search starts from the side with fewer files; every way of a pair stays within what it meets.
    """
    apart = pairs.where("src <> dst").select("project", "src", "dst")
    sides = apart.agg(F.count_distinct("project", "src"), F.count_distinct("project", "dst")).first()
    near, far, walk = ("src", "dst", ("a", "b")) if sides[0] <= sides[1] else ("dst", "src", ("b", "a"))
    start = apart.select("project", F.col(near).alias("seed")).distinct()
    there = steps.select("project", F.col(walk[0]).alias("a"), F.col(walk[1]).alias("b"))
    hit = _spread(there, start.withColumn("node", F.col("seed")), ["project", "seed"], max_depth)
    hit = hit.select("project", "seed", "node")
    joined = apart.join(hit.select("project", F.col("seed").alias(near), F.col("node").alias(far)), ["project", near, far], "left_semi")
    met = cut_lineage(hit.select("project", "node").union(start).distinct())
    inside = steps.join(met.withColumnRenamed("node", "a"), ["project", "a"], "left_semi").join(met.withColumnRenamed("node", "b"), ["project", "b"], "left_semi")
    return cut_lineage(joined), cut_lineage(inside)


def _simple_paths(steps: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """All simple paths of at most `max_depth` edges.

    Pairs without a way are left out first.  A backward search from the targets
    that remain then finds how far every node is from each target, so the
    expansion only walks where the target is still in reach.
    """
    here = pairs.where("src = dst").select("project", "src", "dst", F.array("src").alias("path"))
    joined, inside = _joined_pairs(steps, pairs, max_depth)
    back = inside.select("project", F.col("b").alias("a"), F.col("a").alias("b"))
    targets = joined.select("project", F.col("dst").alias("seed")).distinct()
    reach = _spread(back, targets.withColumn("node", F.col("seed")), ["project", "seed"], max_depth)
    reach = reach.where("node <> seed").select("project", F.col("seed").alias("dst"), F.col("node").alias("b"), "depth")
    to_go = cut_lineage(
        reach.unionByName(targets.select("project", F.col("seed").alias("dst"), F.col("seed").alias("b"), F.lit(0).alias("depth")))
    )
    frontier = joined.select("project", "src", "dst", F.col("src").alias("a"), F.array("src").alias("path"))
    found = [here]
    for step in range(1, max_depth + 1):
        nxt = (
            frontier.join(inside, ["project", "a"])
            .where(~F.array_contains("path", F.col("b")))
            .join(to_go, ["project", "dst", "b"])
            .where(F.col("depth") <= max_depth - step)
            .select("project", "src", "dst", F.col("b").alias("a"), F.concat("path", F.array("b")).alias("path"))
        )
        level = cut_lineage(nxt)
        if level.isEmpty():
            break
        found.append(level.where("a = dst").select("project", "src", "dst", "path"))
        frontier = level.where("a <> dst")
    return _union(found)


def all_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 5) -> DataFrame:
    """Simple paths between each pair (project, src, dst); the reverse direction if there are none."""
    steps = cut_lineage(directed(edges, "forward"))
    wanted = cut_lineage(pairs.select("project", "src", "dst").distinct())
    ahead = cut_lineage(_simple_paths(steps, wanted, max_depth))
    rest = wanted.join(ahead, ["project", "src", "dst"], "left_anti")
    back = _simple_paths(
        steps, cut_lineage(rest.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"))), max_depth
    )
    return (
        ahead.withColumn("reversed", F.lit(False))
        .unionByName(
            back.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"), "path", F.lit(True).alias("reversed"))
        )
        .select("project", "src", "dst", "reversed", (F.size("path") - 1).alias("length"), F.array_join("path", " > ").alias("path"))
    )


# ---- components and cycles ----------------------------------------------------


def _trim(steps: DataFrame) -> DataFrame:
    """Drop edges that cannot lie on a cycle: no way in, or no way out, until all that are left have both."""
    held = _Latest(steps)
    before = held.df.count()
    while before:
        kept = held.df.join(held.df.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(
            held.df.select(F.col("a").alias("b")).distinct(), "b", "left_semi"
        )
        after = held.put(kept.select("a", "b")).count()
        if after == before:
            break
        before = after
    return held.df


#: Steps that a label is pushed before the round is stored.
PUSHES = 4
#: One edge in so many is looked at to choose where a large project's first search starts.
LOOKED_AT = 64
#: Projects with more edges than this are large.
LARGE = 65_536


def _pivots(live: DataFrame) -> DataFrame:
    """(node, root) for each large project: of the files that most of the edges looked at import, the first that imports.

    Only where a search starts depends on this choice, no result does.
    """
    looked = live.where(F.pmod(F.xxhash64("a", "b"), F.lit(LOOKED_AT)) == 0).groupBy("project", "b").agg(F.count(F.lit(1)).alias("n"))
    large = looked.groupBy("project").agg(F.sum("n").alias("edges")).where(F.col("edges") > LARGE // LOOKED_AT)
    best = cut_lineage(top_n(looked.join(large, "project"), ["project"], [F.desc("n"), F.asc("b")], 100))
    able = live.select(F.col("a").alias("b")).join(best.select("b"), "b", "left_semi").distinct()
    first = best.join(able, "b").groupBy("project").agg(F.max(F.struct("n", "b")).alias("top"))
    return cut_lineage(first.select(F.col("top.b").alias("node"), F.col("top.b").alias("root")))


def _around_pivots(live: DataFrame, pivots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the pivots' components, and the edges that may lie on other cycles.

    What a pivot reaches and what reaches it is its component.  No other
    component spans a file that the pivot reaches and one that it does not, nor
    one that reaches it and one that does not.
    """
    ahead, back = _placed(live.select("a", "b")), _placed(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    down, up = _reached(ahead, pivots), _reached(back, pivots)
    core = down.join(up.select("node"), "node").select("node", F.col("root").alias("component"))

    def told(steps: DataFrame, end: str) -> DataFrame:
        for name, side in (("down", down), ("up", up)):
            steps = steps.join(side.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_{name}")), end, "left").fillna(False, [f"{end}_{name}"])
        return steps.where(f"NOT ({end}_down AND {end}_up)")

    rest = told(told(ahead, "a"), "b").where("a_down = b_down AND a_up = b_up")
    return core, rest.select("a", "b")


def _cyclic_ids(steps: DataFrame) -> DataFrame | None:
    """(node, component) of components with more than one file, in numbers; None if no edge lies on a cycle."""
    live = cut_lineage(steps.where("a <> b"))
    done = _Levels(steps.sparkSession, "node LONG, component LONG")
    pivots = _pivots(live)
    if not pivots.isEmpty():
        core, rest = _around_pivots(live, pivots)
        done.add(core)
        live = rest
    live = _trim(live.select("a", "b"))
    while not live.isEmpty():
        ends = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        held = _Latest(ends.withColumn("label", F.col("node")))
        while True:
            moved = held.df.withColumn("was", F.col("label"))
            for _ in range(PUSHES):
                push = moved.select(F.col("node").alias("a"), "label").join(live, "a").select(
                    F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("was")
                )
                # `was` is filled by the node's own row only, so one pass tells what moved
                moved = moved.unionByName(push).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
            step = held.put(moved)
            if step.where("label <> was").isEmpty():
                break
            held.df = step.select("node", "label")
        label = held.df.select("node", "label")
        # edges inside one label, walked backwards from the label's own node
        inner = (
            live.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
            .join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            .where("la = lb")
        )
        inner = cut_lineage(inner.select("a", "b"))
        roots = label.where("node = label").select("node", F.col("node").alias("root"))
        back = _reached(_placed(inner.select(F.col("b").alias("a"), F.col("a").alias("b"))), roots)
        part = done.add(back.unionByName(roots).distinct().select("node", F.col("root").alias("component")))
        gone = part.select("node")
        rest = inner.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        live = _trim(rest.select("a", "b"))
    if not done.count:
        return None
    found = done.all().select("node", "component")
    return found.join(count_rows(found, "component").where("n > 1").select("component"), "component", "left_semi")


def _components_by_rounds(edges: DataFrame) -> DataFrame:
    """(project, node, component) of components with more than one file, all projects at once."""
    seed, names = _number(edges)
    found = _cyclic_ids(_numbered_steps(edges, "forward", seed))
    if found is None:
        return edges.select("project", F.col("src").alias("node"), F.col("src").alias("component")).where(F.lit(False))
    named = cut_lineage(found.join(names, found["node"] == names["id"]).select("project", names["node"], F.col("component").alias("number")))
    least = cut_lineage(named.groupBy("number").agg(F.min("node").alias("component")))
    return named.join(least, "number").select("project", "node", "component")


def _components_whole(edges: DataFrame) -> DataFrame:
    """The same, with the files of its component that a file imports (inner), a project at a time."""
    return cut_lineage(_whole(edges, projects.components, "project STRING, node STRING, component STRING, inner ARRAY<STRING>"))


def cyclic_components(edges: DataFrame, small: int = 0) -> DataFrame:
    """Components with more than one file: (project, node, component), named by the least member.

    Projects of up to `small` edges are worked on whole.  For the others, a large project's component around one of its most imported files is found
    by a search in either direction.  Other edges are trimmed, then each round
    gives every node the least label among the nodes that reach it; a label's
    own node and what can go back to it inside that label is one component.  A
    component never spans two labels, so the next round works on the edges
    within a label alone.  Labels are hashes of the names: however the
    components are chained, a label's share of the chain is cut at a random
    place, so the number of rounds is expected to grow with the logarithm of the chain.
    """
    whole, others = _by_size(edges.select("project", "src", "dst").dropna(), small)
    parts = []
    if whole is not None:
        parts.append(_components_whole(whole).drop("inner"))
    if others is not None:
        parts.append(_components_by_rounds(others))
    return _union(parts)


def scc(nodes: DataFrame, edges: DataFrame, small: int = 0) -> DataFrame:
    """Strongly connected component of every node, named by its least member."""
    big = cyclic_components(edges, small).withColumnRenamed("node", "file")
    return (
        nodes.select("project", "file")
        .join(big, ["project", "file"], "left")
        .select("project", "file", F.coalesce("component", "file").alias("component"))
    )


def _inner_edges(edges: DataFrame, small: int) -> DataFrame:
    """(project, src, dst): different edges between two files of one component."""
    whole, others = _by_size(edges.select("project", "src", "dst").dropna(), small)
    parts = []
    if whole is not None:
        parts.append(_components_whole(whole).select("project", F.col("node").alias("src"), F.explode("inner").alias("dst")))
    if others is not None:
        comp = _components_by_rounds(others)
        steps = others.distinct().where("src <> dst")
        inner = (
            steps.join(comp.select("project", F.col("node").alias("src"), F.col("component").alias("cs")), ["project", "src"])
            .join(comp.select("project", F.col("node").alias("dst"), F.col("component").alias("cd")), ["project", "dst"])
            .where("cs = cd")
        )
        parts.append(inner.select("project", "src", "dst"))
    return cut_lineage(_union(parts))


def cycles(edges: DataFrame, small: int = 0) -> DataFrame:
    """Import cycles: for each edge inside a component the shortest, least way back, written from the least file.

    Every edge on a cycle is on one of them, and there are no more of them than
    such edges, however dense a component is.  Projects of up to `small` edges are worked on whole.
    """
    inner = _inner_edges(edges, small)
    found = _least_ways(inner, inner.select("project", F.col("dst").alias("src"), F.col("src").alias("dst")), small)
    at = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", at, F.size("path")), F.slice("path", 1, at - 1))
    return found.select("project", turned.alias("path")).distinct().select(
        "project", F.size("path").alias("length"), F.array_join("path", " > ").alias("cycle")
    )


# ---- order --------------------------------------------------------------------


def _tour_by_rounds(files: DataFrame, steps: DataFrame) -> DataFrame:
    """(project, file, need, out, depth, last): importers, imports, the round in which a file is read, and how many rounds its project has."""
    steps = cut_lineage(steps)
    indeg = count_rows(steps, "project", "b", name="need").withColumnRenamed("b", "file")
    outdeg = count_rows(steps, "project", "a", name="out").withColumnRenamed("a", "file")
    files = cut_lineage(files.join(indeg, ["project", "file"], "left").join(outdeg, ["project", "file"], "left").fillna(0, ["need", "out"]))
    spark = files.sparkSession
    read = _Levels(spark, "project STRING, file STRING")
    paid = _Levels(spark, "project STRING, file STRING, n LONG")
    ready = read.add(files.where("need = 0").select("project", "file"))
    while not ready.isEmpty():
        # only the files that the frontier imports are looked at; what earlier levels paid is added up
        new = (
            ready.withColumnRenamed("file", "a").join(steps, ["project", "a"]).groupBy("project", F.col("b").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        )
        touched = paid.add(new).select("project", "file")
        total = paid.all().join(touched, ["project", "file"], "left_semi").groupBy("project", "file").agg(F.sum("n").alias("n"))
        ready = read.add(total.join(files, ["project", "file"]).where("n = need").select("project", "file"))
    done = read.all().select("project", "file", (F.col("level").cast("int") - 1).alias("depth"))
    last = done.groupBy("project").agg((F.max("depth") + 1).alias("last"))
    return files.join(done, ["project", "file"], "left").join(last, "project", "left").fillna(0, ["last"])


def guided_tour(nodes: DataFrame, edges: DataFrame, small: int = 0) -> DataFrame:
    """Reading order: peel files whose importers have all been read.

    Returns (project, file, depth, reason); files left over lie on or behind a
    cycle and come last.  Projects of up to `small` files and edges are worked on whole.
    """
    listed = nodes.select("project", F.col("file").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(True).alias("listed"))
    whole, others = _by_size(listed.where("src IS NOT NULL").unionByName(edges.select("project", "src", "dst", F.lit(False).alias("listed"))), small)
    # a file without a name, or in no project, has no importers
    zero = F.lit(0).cast("bigint")
    unknown = nodes.select("project", "file").where("project IS NULL OR file IS NULL").distinct()
    parts = [unknown.select("project", "file", zero.alias("need"), zero.alias("out"), F.lit(0).alias("depth"), F.lit(1).alias("last"))]
    if whole is not None:
        parts.append(_whole(whole, projects.tour, "project STRING, file STRING, need LONG, out LONG, depth INT, last INT"))
    if others is not None:
        files = others.where("listed").select("project", F.col("src").alias("file")).distinct()
        parts.append(_tour_by_rounds(files, directed(others.where("NOT listed"), "forward")))
    reason = F.concat_ws(
        ", ",
        F.when(F.col("need") == 0, "entry point"),
        F.when(F.col("out") > 3, F.concat(F.lit("connects to "), F.col("out"), F.lit(" modules"))),
    )
    told = F.when(F.col("depth").isNull(), "in cycle").when(reason == "", "dependency").otherwise(reason)
    return _union(parts).select("project", "file", F.coalesce("depth", "last").alias("depth"), told.alias("reason"))


# ---- communities ----------------------------------------------------------------


def _halves(node: str, rounds: int) -> list[Column]:
    """Bits that tell in which rounds a file may move, 64 rounds to a column."""
    one = F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    bit = lambda r: F.when(F.pmod(F.xxhash64(node, F.lit(r)), F.lit(2)) == 0, F.call_function("shiftleft", one, F.lit(r % WORD_BITS))).otherwise(none)
    words = [range(w, min(w + WORD_BITS, rounds)) for w in range(0, rounds, WORD_BITS)] or [range(0)]
    return [reduce(Column.bitwiseOR, map(bit, word), none).alias(f"turn{i}") for i, word in enumerate(words)]


def _members_by_rounds(pairs: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """(project, file, community) of the files of `pairs`, all projects at once, each round a join."""
    k = (
        pairs.select("project", F.explode(F.array("src", "dst")).alias("node"))
        .groupBy("project", "node")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    m = count_rows(pairs, "project", name="m")
    # rounds work on numbers in the order of the names, so ties between communities stay as they are between names
    ordered = k.join(m, "project").repartitionByRange("project", "node").sortWithinPartitions("project", "node")
    names = cut_lineage(ordered.select("project", "node", "k", "m", F.monotonically_increasing_id().alias("id"), *_halves("node", rounds * 2)))
    turns = [c for c in names.columns if c.startswith("turn")]
    ids = names.select("project", "node", "id", *turns)
    linked = cut_lineage(
        pairs.join(ids.select("project", F.col("node").alias("src"), F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in turns]), ["project", "src"])
        .join(ids.select("project", F.col("node").alias("dst"), F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in turns]), ["project", "dst"])
        .drop("project", "src", "dst")
    )
    around = cut_lineage(
        linked.select(F.col("a").alias("node"), F.col("b").alias("other"), *[F.col(f"a_{c}").alias(c) for c in turns])
        .unionByName(linked.select(F.col("b").alias("node"), F.col("a").alias("other"), *[F.col(f"b_{c}").alias(c) for c in turns]))
        .distinct()
    )
    held = _Latest(names.select(F.col("id").alias("node"), "k", "m", *turns, F.col("id").alias("c")))

    def moves(state: DataFrame, who: Column) -> DataFrame:
        """(node, to) of the files `who` that gain by moving."""
        told = state.join(state.groupBy("c").agg(F.sum("k").alias("sigma")), "c")
        links = (
            around.where(who)
            .select("node", "other")
            .join(told.select(F.col("node").alias("other"), "c", "sigma"), "other")
            .repartition("node")
            .groupBy("node", "c")
            .agg(F.count(F.lit(1)).alias("k_in"), F.first("sigma").alias("sigma"))
        )
        own = told.where(who).select("node", "k", "m", F.col("c").alias("own"), F.col("sigma").alias("own_sigma"))
        weight = F.col("k") / (2 * F.col("m")) * resolution
        scored = own.join(links, "node").select(
            "node",
            "c",
            "own",
            F.when(F.col("c") == F.col("own"), F.col("k_in") - (F.col("sigma") - F.col("k")) * weight)
            .otherwise(F.col("k_in") - F.col("sigma") * weight)
            .alias("gain"),
            (-(F.col("own_sigma") - F.col("k")) * weight).alias("alone"),
        )
        return (
            scored.groupBy("node")
            .agg(
                F.min_by(F.struct("c", "gain"), F.struct((-F.col("gain")).alias("g"), F.col("c").alias("c"))).alias("b"),
                F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"),
                F.first("alone").alias("alone"),
            )
            .where(F.col("b.gain") > F.coalesce("stay", "alone") + 1e-12)
            .select("node", F.col("b.c").alias("to"))
        )

    for r in range(rounds * 2):
        state = held.df
        # the half is taken before anything is joined
        turn = F.get(F.array(*turns), F.lit(r // WORD_BITS))
        best = cut_lineage(moves(state, F.call_function("shiftrightunsigned", turn, F.lit(r % WORD_BITS)).bitwiseAND(F.lit(1).cast("long")) == 1))
        if best.isEmpty() and moves(state, F.lit(True)).isEmpty():
            break
        held.put(state.join(best, "node", "left").select("node", "k", "m", *turns, F.coalesce("to", "c").alias("c")))
    state = held.df.select(F.col("node").alias("id"), "c")
    least = state.groupBy("c").agg(F.min("id").alias("first"))
    called = state.join(least, "c").join(names.select(F.col("id").alias("first"), F.col("node").alias("community")), "first")
    return called.select("id", "community").join(names.select("id", "project", F.col("node").alias("file")), "id").select("project", "file", "community")


def community_members(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, rounds: int = 10, small: int = 0) -> DataFrame:
    """Community of every file by local modularity moves.

    Each round counts every file's edges into the neighbouring communities and
    moves it to the best one.  Only half of the files move in a round, a fresh
    half each time (by hash), which keeps neighbours from swapping for ever.  Ties go to the least
    community name.  It ends after `rounds` passes, or when no file anywhere gains by a move.
    Projects of up to `small` edges are worked on whole.
    """
    whole, others = _by_size(edges.select("project", "src", "dst"), small)
    parts = []
    if whole is not None:
        turns = [c.alias(f"{end}_turn{i}") for end in ("src", "dst") for i, c in enumerate(_halves(end, rounds * 2))]
        rows = whole.select("project", "src", "dst", *turns)
        schema = "project STRING, file STRING, community STRING"
        parts.append(cut_lineage(_whole(rows, projects.communities, schema, words=len(turns) // 2, rounds=rounds * 2, resolution=resolution)))
    if others is not None:
        parts.append(_members_by_rounds(others, resolution, rounds))
    inside = _union(parts)
    return (
        nodes.select("project", "file")
        .distinct()
        .join(inside, ["project", "file"], "left")
        .select("project", "file", F.coalesce("community", "file").alias("community"))
    )


def communities(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities of two or more files: size, inner and outer edges, density."""
    size = count_rows(members, "project", "community", name="files").where("files >= 2")
    of = members.select("project", "file", "community")
    ends = (
        edges.select("project", "src", "dst")
        .join(of.select("project", F.col("file").alias("src"), F.col("community").alias("cs")), ["project", "src"])
        .join(of.select("project", F.col("file").alias("dst"), F.col("community").alias("cd")), ["project", "dst"])
    )
    same = F.col("cs") == F.col("cd")
    touched = ends.select(
        "project",
        same.alias("inner"),
        F.explode(F.when(same, F.array("cs")).otherwise(F.array("cs", "cd"))).alias("community"),
    )
    flow = touched.groupBy("project", "community").agg(
        F.count_if("inner").alias("internal_edges"), F.count_if(~F.col("inner")).alias("external_edges")
    )
    most = F.col("files") * (F.col("files") - 1) / 2
    return (
        size.join(flow, ["project", "community"], "left")
        .fillna(0, ["internal_edges", "external_edges"])
        .withColumn("density", half_up2(F.col("internal_edges") / most))
    )


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Modularity of a division into communities, per project."""
    of = members.select("project", "file", "community")
    pairs = edges.select("project", "src", "dst")
    m = count_rows(pairs, "project", name="m")
    inner = (
        pairs.join(of.select("project", F.col("file").alias("src"), F.col("community").alias("cs")), ["project", "src"])
        .join(of.select("project", F.col("file").alias("dst"), F.col("community").alias("cd")), ["project", "dst"])
        .groupBy("project")
        .agg(F.count_if(F.col("cs") == F.col("cd")).alias("inner"))
    )
    sigma = (
        pairs.select("project", F.explode(F.array("src", "dst")).alias("file"))
        .join(of, ["project", "file"])
        .groupBy("project", "community")
        .agg(F.count(F.lit(1)).alias("s"))
        .groupBy("project")
        .agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    )
    return (
        m.join(inner, "project")
        .join(sigma, "project")
        .select("project", (F.col("inner") / F.col("m") - F.col("ss") / (4 * F.col("m") * F.col("m"))).alias("modularity"))
    )


# ---- reference chains and containment --------------------------------------------


def resolve_ref_chains(refs: DataFrame, elements: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Where following references leads from each element: resolved, broken or cycle.

    One chain per (start, type, end): the shortest, then the least.
    """
    known = elements.select("project", F.col("path").alias("node")).distinct()
    hops = refs.select("project", F.col("source_class").alias("node"), F.col("target_class").alias("target")).distinct()
    flagged = cut_lineage(
        hops.join(known, ["project", "node"], "left_semi").join(
            known.select("project", F.col("node").alias("target"), F.lit(True).alias("live")), ["project", "target"], "left"
        )
    )
    onward = cut_lineage(flagged.where("live").select("project", "node").distinct())
    frontier = known.join(flagged, ["project", "node"], "left_semi").select(
        "project", F.col("node").alias("start"), "node", F.array("node").alias("chain")
    )
    found: list[DataFrame] = []
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        grown = frontier.join(flagged, ["project", "node"]).select(
            "project",
            "start",
            F.col("target").alias("node"),
            F.concat("chain", F.array("target")).alias("chain"),
            F.when(F.col("live").isNull(), "broken")
            .when(F.array_contains("chain", F.col("target")), "cycle")
            .otherwise("open")
            .alias("type"),
        )
        level = cut_lineage(grown)
        if level.isEmpty():
            break
        found.append(level.where("type <> 'open'"))
        open_ = level.where("type = 'open'")
        found.append(open_.join(onward, ["project", "node"], "left_anti").withColumn("type", F.lit("resolved")))
        frontier = open_.select("project", "start", "node", "chain")
    if not found:
        found = [
            flagged.select("project", F.col("node").alias("start"), "node", F.array("node").alias("chain"), F.lit("open").alias("type")).where(F.lit(False))
        ]
    return (
        _union([f.select("project", "start", "type", F.col("node").alias("end"), "chain") for f in found])
        .groupBy("project", "start", "type", "end")
        .agg(F.min(F.struct(F.size("chain").alias("length"), F.array_join("chain", " > ").alias("chain"))).alias("c"))
        .select("project", "start", "type", "end", "c.length", "c.chain")
    )


def occurrence_paths(elements: DataFrame) -> DataFrame:
    """Every containment path of a child name, following names upwards through all their parents."""
    parts = F.split("path", "/")
    links = cut_lineage(
        elements.where(F.col("path").contains("/"))
        .select("project", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("parent"))
        .distinct()
    )
    named = links.select("project", F.col("name").alias("top")).distinct()
    walk = links.select("project", "name", F.col("parent").alias("top"), F.array("parent", "name").alias("path"))
    found: list[DataFrame] = []
    while True:
        found.append(walk.join(named, ["project", "top"], "left_anti").select("project", "name", "path"))
        up = walk.join(links.select("project", F.col("name").alias("top"), "parent"), ["project", "top"]).where(
            ~F.array_contains("path", F.col("parent"))
        )
        walk = cut_lineage(
            up.select("project", "name", F.col("parent").alias("top"), F.concat(F.array("parent"), "path").alias("path"))
        )
        if walk.isEmpty():
            break
    return _union(found).select("project", "name", F.array_join("path", "/").alias("full_path")).distinct()
