"""Exact top-k inner product search with cover trees over data and queries.

Rows are dealt to blocks around pivots.  Each block of data and each group of
queries gets a cover tree of its own: a node is a centre and a covering radius,
its children cover its points at half that radius, and leaves hold a few dozen
points.  A search walks a query tree and a data tree together; a pair of nodes
is pruned when the best score their radii allow is below the worst kth score of
the queries in the query node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborist.session import cut_lineage

PIVOTS = 64
BLOCK_ROWS = 2048
GROUP_ROWS = 512
SLICE_GROUPS = 16
LEAF_ROWS = 64
EXACT = float(1 << 53)

ROWS = "row LONG, vec_id LONG, v ARRAY<LONG>, pivot INT, block LONG"
TREES = "id LONG, pivot INT, rows BINARY, ids BINARY, points BINARY, dim INT, nodes BINARY"
HITS = "row LONG, query_id LONG, vec_id LONG, score LONG"


@dataclass
class CoverTree:
    """Points in leaf order, and one line per node: centre, radius, begin, end, first child, children."""

    rows: np.ndarray
    ids: np.ndarray
    points: np.ndarray
    nodes: np.ndarray

    def __post_init__(self) -> None:
        self.floats = self.points.astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.floats, self.floats))
        self.centre = self.nodes[:, 0].astype(np.int64)
        self.radius = self.nodes[:, 1]
        self.begin, self.end, self.first, self.children = (self.nodes[:, k].astype(np.int64) for k in range(2, 6))


def build(rows: np.ndarray, ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> CoverTree:
    """Cover tree of a non-empty block, level by level.

    At each level the members of a node are covered by balls of half its radius
    around members picked greedily, so centres of one level are apart by more
    than that.  Balls of fewer than `leaf_rows` / 4 points share a leaf.
    """
    x = points.astype(np.float64)
    mean = x.mean(axis=0)
    squares = np.einsum("ij,ij->i", x, x)

    def away(centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares[members] + squares[centre] - 2 * (x[members] @ x[centre]), 0))

    start = int(np.argmin(((x - mean) ** 2).sum(axis=1)))
    nodes: list[list[float]] = []
    order: list[int] = []
    queue: list[tuple[int, np.ndarray, bool]] = [(start, np.arange(len(x)), False)]
    spans: list[np.ndarray] = []
    at = 0
    while at < len(queue):
        centre, members, last = queue[at]
        distance = away(centre, members)
        radius = float(distance.max()) * (1 + 1e-9) + 1e-6
        spans.append(members)
        if last or len(members) <= leaf_rows or distance.max() == 0:
            nodes.append([centre, radius, 0, 0, 0, 0])
        else:
            left, balls, small = members, [], []
            pick = centre
            while len(left):
                d = away(pick, left)
                inside = d <= distance.max() / 2
                inside |= left == pick
                ball = left[inside]
                (balls if len(ball) >= leaf_rows // 4 else small).append((pick, ball))
                left = left[~inside]
                pick = int(left[0]) if len(left) else -1
            children = [(p, b, False) for p, b in balls]
            for k in range(0, len(small), leaf_rows):
                pool = np.concatenate([b for _, b in small[k : k + leaf_rows]])
                children.append((int(pool[0]), pool, True))
            nodes.append([centre, radius, 0, 0, len(queue), len(children)])
            queue.extend(children)
        at += 1
    # Number the points so that every node's points are contiguous: leaves in depth-first order.
    stack = [(0, False)]
    while stack:
        k, seen = stack.pop()
        first, count = int(nodes[k][4]), int(nodes[k][5])
        if seen:
            nodes[k][2], nodes[k][3] = nodes[first][2], nodes[first + count - 1][3]
        elif count:
            stack.append((k, True))
            stack.extend((c, False) for c in range(first + count - 1, first - 1, -1))
        else:
            nodes[k][2] = len(order)
            order.extend(spans[k].tolist())
            nodes[k][3] = len(order)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    table = np.array(nodes, dtype=np.float64)
    table[:, 0] = rank[table[:, 0].astype(np.int64)]
    return CoverTree(rows[order], ids[order], points[order], table)


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None):
        self.k = k
        self.scores: list[np.ndarray] = []
        self.kth = np.full(queries, -np.inf) if floor is None else floor.astype(np.float64)
        self.held = np.zeros(0, dtype=[("q", np.int64), ("s", np.int64), ("i", np.int64)])

    def offer(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, valid: np.ndarray) -> None:
        """Scores of queries `q` (lines) with points `ids` (columns)."""
        worth = valid & (scores >= self.kth[q][:, None])
        if scores.shape[1] > self.k and worth.sum() > 4 * self.k * len(q):
            kth = np.partition(np.where(valid, scores, np.iinfo(np.int64).min), -self.k, axis=1)[:, -self.k]
            worth &= scores >= kth[:, None]
        line, column = np.nonzero(worth)
        if not len(line):
            return
        new = np.empty(len(line), dtype=self.held.dtype)
        new["q"], new["s"], new["i"] = q[line], scores[line, column], ids[column]
        touched = np.isin(self.held["q"], np.unique(new["q"]))
        pool = np.concatenate([self.held[touched], new])
        pool = pool[np.lexsort((pool["i"], -pool["s"], pool["q"]))]
        starts = np.r_[True, pool["q"][1:] != pool["q"][:-1]]
        place = np.arange(len(pool)) - np.maximum.accumulate(np.where(starts, np.arange(len(pool)), 0))
        pool = pool[place < self.k]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.kth[pool["q"][full]] = np.maximum(self.kth[pool["q"][full]], pool["s"][full])
        self.held = np.concatenate([self.held[~touched], pool])


def search(queries: CoverTree, data: CoverTree, k: int, floor: np.ndarray | None = None) -> Best:
    """Dual-tree search: the k best scores of every query among the points of `data`.

    `floor` holds scores that are known to be reached k times elsewhere; lower
    ones are left out.  A query's own row is no candidate.
    """
    best = Best(len(queries.rows), k, floor)
    if queries.points.shape[1] != data.points.shape[1]:
        width = max(queries.points.shape[1], data.points.shape[1])
        queries, data = (CoverTree(t.rows, t.ids, np.pad(t.points, ((0, 0), (0, width - t.points.shape[1]))), t.nodes) for t in (queries, data))
    exact = queries.norms.max(initial=0) * data.norms.max(initial=0) < EXACT

    def bounds(a: int, b: np.ndarray) -> np.ndarray:
        ca, cb = queries.centre[a], data.centre[b]
        dot = data.floats[cb] @ queries.floats[ca]
        top = dot + queries.radius[a] * data.norms[cb] + data.radius[b] * (queries.norms[ca] + queries.radius[a])
        return top + 1e-9 * np.abs(top) + 1e-6

    stack = [(0, 0, np.inf)]
    while stack:
        a, b, bound = stack.pop()
        q = slice(queries.begin[a], queries.end[a])
        if bound < best.kth[q].min():
            continue
        if not queries.children[a] and not data.children[b]:
            d = slice(data.begin[b], data.end[b])
            if exact:
                scores = np.rint(queries.floats[q] @ data.floats[d].T).astype(np.int64)
            else:
                scores = queries.points[q] @ data.points[d].T
            valid = queries.rows[q][:, None] != data.rows[d][None, :]
            best.offer(np.arange(q.start, q.stop), data.ids[d], scores, valid)
        elif data.children[b] and (not queries.children[a] or data.radius[b] >= queries.radius[a]):
            kids = np.arange(data.first[b], data.first[b] + data.children[b])
            value = bounds(a, kids)
            stack.extend((a, int(kids[j]), float(value[j])) for j in np.argsort(value))
        else:
            kids = range(queries.first[a], queries.first[a] + queries.children[a])
            stack.extend((c, b, float(bounds(c, np.array([b]))[0])) for c in kids)
    return best


def pack(tree: CoverTree, number: int, pivot: int) -> dict:
    return {
        "id": number, "pivot": pivot, "rows": tree.rows.tobytes(), "ids": tree.ids.tobytes(), "points": tree.points.tobytes(),
        "dim": tree.points.shape[1], "nodes": tree.nodes.tobytes(),
    }


def unpack(row: dict) -> CoverTree:
    rows = np.frombuffer(row["rows"], dtype=np.int64)
    points = np.frombuffer(row["points"], dtype=np.int64).reshape(len(rows), row["dim"])
    return CoverTree(rows, np.frombuffer(row["ids"], dtype=np.int64), points, np.frombuffer(row["nodes"], dtype=np.float64).reshape(-1, 6))


ARROW_TREES = pa.schema([("id", pa.int64()), ("pivot", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("points", pa.binary()), ("dim", pa.int32()), ("nodes", pa.binary())])
ARROW_HITS = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def matrix(vectors: list[list[int]]) -> np.ndarray:
    """Vectors as lines; shorter ones end in zeros."""
    width = max((len(v) for v in vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, dtype=np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def trees(rows: DataFrame, key: str) -> DataFrame:
    """One cover tree per value of `key`, as a row; groups are bounded by construction."""

    def plant(table: pa.Table) -> pa.Table:
        tree = build(table["row"].to_numpy(), table["vec_id"].to_numpy(), matrix(table["v"].to_pylist()))
        return pa.Table.from_pylist([pack(tree, table[key][0].as_py(), table["pivot"][0].as_py())], schema=ARROW_TREES)

    return cut_lineage(rows.groupBy(key).applyInArrow(plant, TREES))


def deal(vectors: DataFrame, block_rows: int, pivots: int) -> DataFrame:
    """Rows (row, vec_id, v) with their nearest pivot and a block of about `block_rows` rows around it.

    The pivots are a bounded sample; what they decide is speed alone.  A pivot
    that draws many rows has many blocks.
    """
    sample = [r["v"] for r in vectors.orderBy(F.xxhash64("row")).limit(pivots).select("v").collect()]
    if not sample:
        return vectors.withColumns({"pivot": F.lit(0), "block": F.lit(0).cast("long")})
    centres = matrix(sample).astype(np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2).to_pylist()).astype(np.float64)
            width = max(x.shape[1], centres.shape[1])
            c = np.pad(centres, ((0, 0), (0, width - centres.shape[1])))
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
            near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["row", "vec_id", "v", "pivot"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("pivot", T.IntegerType())])
    placed = cut_lineage(vectors.mapInArrow(nearest, schema))
    counts = {r["pivot"]: r["count"] for r in placed.groupBy("pivot").count().collect()}  # at most `pivots` rows
    first, blocks, total = [], [], 0
    for p in range(len(sample)):
        first.append(total)
        blocks.append(max(1, -(-counts.get(p, 0) // block_rows)))
        total += blocks[-1]
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("pivot"))
    return placed.withColumn("block", (at(first) + F.pmod(F.xxhash64(F.lit(5), "row"), at(blocks))).cast("long"))


def exact_top_k(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 64,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The k rows of highest integer inner product for every query: query_id, rank, vec_id, score.

    A component x counts as floor(scale * x) in double precision.  Queries are
    the rows whose id is divisible by `every`; candidates are all rows but the
    query's own, and all of them are returned if fewer than k.  Ties go to the
    smaller id.  Vectors that are null or hold a null or non-finite component,
    and rows with a null id, which nothing could name, take no part.  Of
    vectors of different lengths the shorter one ends in zeros.  Repeated rows
    are rows of their own, as candidates and as queries.  Extra columns are
    ignored; an empty table gives an empty result.

    The query set meets the data in blocks: first each query group searches
    the blocks around its own pivot, which gives every query a kth score; then
    it goes to those other blocks whose bound reaches the group's worst one.
    """
    v = F.col(vector_col)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, odd)
    numbered = cut_lineage(
        vectors.where(usable).select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
            F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
        )
    )
    rows = cut_lineage(deal(numbered, block_rows, pivots))
    data = trees(rows, "block")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    share = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("_parts"))
    grouped = asked.join(share, "block").withColumn(
        "qgroup", F.xxhash64("block", F.pmod(F.xxhash64(F.lit(9), "row"), F.col("_parts")))
    )
    queries = trees(grouped.drop("_parts", "block"), "qgroup")

    def found(best: Best, tree: CoverTree) -> pa.Table:
        h = best.held
        return pa.table([pa.array(tree.rows[h["q"]]), pa.array(tree.ids[h["q"]]), pa.array(h["i"]), pa.array(h["s"])], schema=ARROW_HITS)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """Query groups (left) against one block of data (right)."""
        out = [ARROW_HITS.empty_table()]
        if left.num_rows and right.num_rows:
            block = unpack(right.to_pylist()[0])
            for q in left.to_pylist():
                tree = unpack(q)
                floor = np.frombuffer(q["floor"], dtype=np.float64) if q.get("floor") else None
                out.append(found(search(tree, block, k, floor), tree))
        return pa.concat_tables(out)

    def against(pairs: DataFrame) -> DataFrame:
        """`pairs`: query trees with a `block` and a `slice`; blocks are sent once per slice of query groups."""
        needed = pairs.select((F.col("block") + 0).alias("block"), (F.col("slice") + 0).alias("slice")).distinct()
        blocks = data.withColumnRenamed("id", "block").drop("pivot").join(needed, "block")
        return pairs.groupBy("block", "slice").cogroup(blocks.groupBy("block", "slice")).applyInArrow(lambda a, b: meet(a, b), HITS)

    slices = F.pmod(F.col("id"), F.greatest(F.lit(1), F.ceil(F.lit(queries.count()) / F.lit(SLICE_GROUPS)))).alias("slice")
    summary = data.select(F.col("id").alias("block"), F.col("pivot").alias("_pivot"))
    home = cut_lineage(against(queries.join(summary, F.col("pivot") == F.col("_pivot")).select(*queries.columns, "block", slices)))

    kth = home.groupBy("row").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    kth = kth.select("row", F.get("s", k - 1).alias("kth"))
    members = grouped.select(F.col("qgroup").alias("id"), "row").join(kth, "row", "left")
    floors = members.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("row", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf")))))).alias("floors"))

    def bound_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keep of each query group the blocks whose bound reaches the group's worst kth score."""
        for batch in batches:
            for row in batch.to_pylist():
                tree = unpack(row)
                kths = {e["key"]: e["value"] for e in row["floors"]}
                floor = np.array([kths[r] for r in tree.rows.tolist()])
                c, r = tree.floats[tree.centre[0]], tree.radius[0]
                keep = []
                for s in row["blocks"]:
                    other = np.array(s["centre"], dtype=np.float64)
                    width = max(len(c), len(other))
                    a, b = np.pad(c, (0, width - len(c))), np.pad(other, (0, width - len(other)))
                    top = a @ b + r * np.linalg.norm(b) + s["radius"] * (np.linalg.norm(a) + r)
                    if top + 1e-9 * abs(top) + 1e-6 >= floor.min():
                        keep.append(s["block"])
                if keep:
                    packed = {n: row[n] for n in ("id", "pivot", "rows", "ids", "points", "dim", "nodes")}
                    yield pa.RecordBatch.from_pylist([packed | {"floor": floor.tobytes(), "blocks": keep}], schema=pa.schema([*ARROW_TREES, ("floor", pa.binary()), ("blocks", pa.list_(pa.int64()))]))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                tree = unpack(row)
                out.append({"block": row["id"], "pivot": row["pivot"], "centre": tree.floats[tree.centre[0]].tolist(), "radius": float(tree.radius[0])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))

    # Outlines travel in batches of a bounded number of blocks, one row per batch, keyed by batch number.
    outlines = cut_lineage(data.mapInArrow(outline, "block LONG, pivot INT, centre ARRAY<DOUBLE>, radius DOUBLE"))
    batches = max(1, -(-outlines.count() // 1024))
    batched = outlines.groupBy(F.pmod("block", F.lit(batches)).alias("batch")).agg(F.collect_list(F.struct("block", "pivot", "centre", "radius")).alias("blocks"))
    sent = queries.join(floors, "id").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
    candidates = sent.join(batched, "batch").withColumn("blocks", F.filter("blocks", lambda s: s["pivot"] != F.col("pivot")))
    kept = cut_lineage(candidates.select(*queries.columns, F.map_entries("floors").alias("floors"), "blocks").mapInArrow(
        bound_blocks, TREES + ", floor BINARY, blocks ARRAY<LONG>"
    ))
    others = against(kept.withColumn("block", F.explode("blocks")).drop("blocks").select("*", slices))

    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = home.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

