"""N-gram Jaccard join by a token-group matrix.

Documents that could be similar are partitioned into groups.  A group stores
the union of its members' shingles; the matrix says which groups hold a
shingle.  Counting a document's shingles over the matrix bounds its overlap
with every member of a group at once, and only groups whose count reaches what
the threshold asks for are opened, that is, compared member by member.

Which documents could be similar is found without loss.  Two sets of sizes n
and m within the threshold differ in at most D = (n + m)(1 - t) / (1 + t)
shingles.  Deal all shingles to more than D parts by hash: some parts agree in
full.  So documents that share no part need not meet.  Parts with fewer than
two shingles say little and are left out; a document where so many are light
that an agreeing pair might have no other part keeps them.  Sets of few
shingles use triples of their least shingles instead: two sets that share o
shingles have their three least common ones among the first n - o + 3.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import components, fresh, give_back
from arborist.llm.shingles import digests, mix, shingle_sets, text_chunks
from arborist.session import cut_lineage

SMALL = 32
NO_ID = (1 << 63) - 1  # stands for a null id
FLUSH = 1 << 18
BUCKET_KEYS = 1 << 19
BLOCK_SHINGLES = 4 << 20
TASK_SHINGLES = 1 << 18
COMMON = 64  # sets that share a key within a task, beyond which the task sends on the least of them only

U64 = np.uint64
SETS = pa.schema([("node", pa.binary()), ("n_shingles", pa.int64())])
PACKS = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("line", pa.binary()), ("nodes", pa.binary())])
STARS = pa.schema([("key", pa.int64()), ("node", pa.binary()), ("leader", pa.binary())])
LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


class Parts:
    """How sets are dealt to parts, for similarity num/den or more."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        self.high: list[int] = []
        low = 1
        while low <= largest:
            self.high.append(low * den // num)
            low = self.high[-1] + 1
        high = np.array(self.high, dtype=np.int64)
        differ = 2 * high * (den - num) // (den + num)
        self.parts = np.array([self.enough(int(d) + 1, int(h)) for d, h in zip(differ, high, strict=True)], dtype=np.int64)
        self.bounds = high

    @staticmethod
    def enough(least: int, size: int) -> int:
        """Parts for sets of `size`: `least`, and as many more as keep the light ones of nearly all sets below them."""
        best, at, more = -math.inf, 1, 1
        while more <= 2 * least:
            load = size / (least + more)
            light = (1 + load) * math.exp(-load)
            expected = (least + more) * light
            margin = (more - expected) / math.sqrt(expected * (1 - light))
            if margin > best:
                best, at = margin, more
            if margin >= 3.5:
                break
            more += max(1, more // 16)
        return least + at

    def spare(self, n: np.ndarray, scheme: np.ndarray) -> np.ndarray:
        """Light parts a set of size n may have without losing a partner."""
        partner = np.minimum(self.bounds[scheme], n * self.den // self.num)
        return self.parts[scheme] - 1 - (n + partner) * (self.den - self.num) // (self.den + self.num)

    def needed(self, n: int) -> int:
        """Least overlap of a set of size n with any partner."""
        return -(-self.num * n // self.den)

    def keys(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, line of the set) such that any two sets within the threshold, unless equal, share a key."""
        n = np.diff(bounds)
        out_keys, out_line = [], []
        for k in np.flatnonzero((n >= 3) & (n <= SMALL * self.den // self.num)):
            least = hashes[bounds[k] : bounds[k] + int(n[k]) - self.needed(int(n[k])) + 3]
            triples = np.array(list(combinations(least.tolist(), 3)), dtype=U64)
            out_keys.append(mix(mix(mix(triples[:, 0]) + triples[:, 1]) + triples[:, 2]))
            out_line.append(np.full(len(triples), k))
        large = np.flatnonzero(n > SMALL)
        if len(large):
            sizes = n[large]
            at = np.repeat(bounds[large] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            h, line = hashes[at], np.repeat(np.arange(len(large)), sizes)
            value = mix(h ^ U64(0xD6E8FEB86659FD93))
            own = np.searchsorted(self.bounds, sizes)
            for step in (0, 1):
                scheme = own + step
                seed = mix(scheme.astype(U64) + U64(77))
                parts = self.parts[scheme]
                part = (mix(h ^ seed[line]) % parts[line].astype(U64)).astype(np.int64)
                place = (line.astype(np.int64) << 32) | part
                order = np.argsort(place, kind="stable")
                place = place[order]
                starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                count = np.diff(np.r_[starts, len(place)])
                total = np.add.reduceat(value[order], starts)
                of, which = place[starts] >> 32, place[starts] & 0xFFFFFFFF
                key = mix(total + mix(which.astype(U64) + seed[of]))
                heavy = count >= 2
                light = parts - np.bincount(of[heavy], minlength=len(large))
                open_line = light > self.spare(sizes, scheme)
                keep = heavy | open_line[of]
                out_keys.append(key[keep])
                out_line.append(large[of[keep]])
                for k in np.flatnonzero(open_line):  # their empty parts
                    empty = np.setdiff1d(np.arange(parts[k]), which[of == k])
                    out_keys.append(mix(mix(empty.astype(U64) + seed[k])))
                    out_line.append(np.full(len(empty), large[k]))
        if not out_keys:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        return np.concatenate(out_keys), np.concatenate(out_line)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two ascending arrays."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(a.searchsorted(b), len(a) - 1)] == b).sum()) if len(b) else 0


class Group:
    """Members of a group, and their shingles one after another for a look at all of them."""

    def __init__(self) -> None:
        self.members: list[int] = []
        self.joined = 0
        self.flat = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)


class Matrix:
    """Token-group matrix over the sets of one block; `link` adds sets and returns links that span the components."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        flat = np.concatenate(sets) if sets else np.zeros(0, U64)
        tokens, codes = np.unique(flat, return_inverse=True)
        bounds = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
        self.sets = [np.sort(codes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        self.first = np.full(len(tokens), -1, dtype=np.int64)  # the first group that holds a token
        self.more: dict[int, array] = {}  # the others
        self.shared = np.zeros(len(tokens), dtype=bool)
        self.groups: list[Group] = []
        self.parent = list(range(len(sets)))

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def similar(self, a: int, b: int) -> bool:
        n, m = len(self.sets[a]), len(self.sets[b])
        if self.den * min(n, m) < self.num * max(n, m):
            return False
        o = overlap(self.sets[a], self.sets[b])
        return self.den * o >= self.num * (n + m - o)

    def counts(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups that hold shingles of `s`, and how many: the bounds."""
        hit = self.first[s]
        found = [hit[hit >= 0], *(np.array(self.more[t], dtype=np.int64) for t in s[self.shared[s]].tolist())]
        held = np.bincount(np.concatenate(found), minlength=1)
        groups = np.flatnonzero(held)
        return groups, held[groups]

    def open(self, g: Group, k: int) -> int | None:
        """A member within the threshold of set k, if there is one."""
        for m in g.members[:2] + g.members[2:][-2:]:
            if self.similar(k, m):
                return m
        if len(g.members) <= 4:
            return None
        if g.joined < len(g.members):
            if g.joined * 2 <= len(g.members) or len(g.members) - g.joined > 64:
                arrays = [self.sets[m] for m in g.members]
                g.starts = np.r_[0, np.cumsum([len(a) for a in arrays])[:-1]].astype(np.int64)
                g.flat, g.joined = np.concatenate(arrays), len(g.members)
        s = self.sets[k]
        same = s[np.minimum(s.searchsorted(g.flat), len(s) - 1)] == g.flat
        if g.joined:
            o = np.add.reduceat(same, g.starts, dtype=np.int64)
            m = np.diff(np.r_[g.starts, len(g.flat)])
            near = np.flatnonzero(self.den * o >= self.num * (len(s) + m - o))
            if len(near):
                return g.members[int(near[0])]
        return next((m for m in g.members[g.joined :] if self.similar(k, m)), None)

    def link(self, order: list[int], probes: int = 0) -> list[tuple[int, int]]:
        """Add the sets in `order`; the last `probes` of them are only compared, not added."""
        links = []
        for place, k in enumerate(order):
            s = self.sets[k]
            home = None
            if len(s):
                groups, bound = self.counts(s)
                enough = bound >= -(-self.num * len(s) // self.den)
                groups, bound = groups[enough], bound[enough]
                for g in groups[np.argsort(-bound, kind="stable")].tolist():
                    group = self.groups[g]
                    if self.find(group.members[0]) == self.find(k):
                        home = g if home is None else home
                        continue
                    other = self.open(group, k)
                    if other is not None:
                        self.parent[self.find(k)] = self.find(other)
                        links.append((k, other))
                        home = g if home is None else home
            if place >= len(order) - probes or not len(s):
                continue
            fresh_group = home is None
            if fresh_group:
                home = len(self.groups)
                self.groups.append(Group())
            self.groups[home].members.append(k)
            hit = self.first[s]
            self.first[s[hit < 0]] = home
            for t in s[(hit >= 0) & (hit != home)].tolist():
                others = self.more.setdefault(t, array("q"))
                if fresh_group or home not in others:
                    others.append(home)
                self.shared[t] = True
        return links


def shingled(docs: DataFrame, text: str, width: int) -> DataFrame:
    """`docs` with `node`, the digest of the row's shingle set, and `n_shingles`, in place of its text."""
    kept = [c for c in docs.columns if c != text]
    source = docs.select(*kept, text)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["node BINARY", "n_shingles LONG"])
    names = [*kept, "node", "n_shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, raw, offsets in text_chunks(batch.column(batch.num_columns - 1)):
                h, bounds = shingle_sets(raw, offsets, width)
                rows = len(offsets) - 1
                columns = batch.slice(begin, rows).columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, binaries(digests(h, bounds)), pa.array(np.diff(bounds))], names=names)
        give_back()

    return source.mapInArrow(run, schema)


def binaries(lines: np.ndarray) -> pa.Array:
    """Lines of two 64-bit numbers as 16-byte values that sort as they do."""
    raw = np.ascontiguousarray(lines.astype(">u8"))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(lines), [None, pa.py_buffer(raw)]).cast(pa.binary())


def numbers(values: pa.Array) -> np.ndarray:
    """The inverse of `binaries`."""
    return np.frombuffer(b"".join(values.to_pylist()), dtype=">u8").astype(U64).reshape(-1, 2)


def stars(texts: DataFrame, width: int, num: int, den: int, buckets: int, common: int = COMMON) -> DataFrame:
    """(key, node, leader) for every key that different sets share: each of them with the least one.

    Keys travel packed, thousands to a row, to buckets of bounded size; a task
    sends a set once, however often it meets it.  Where many of its sets share a
    key, as when all texts hold a passage, a task makes a star of them by itself
    and sends the least on: a bucket gets such a key as often as tasks meet it.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Parts(num, den)
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        own_bucket = buckets + (TaskContext.get().partitionId() << 32)  # of this task alone

        def packed(bucket: int, keys: np.ndarray, line: np.ndarray, nodes: np.ndarray) -> dict:
            own, index = np.unique(line, return_inverse=True)
            return {"bucket": bucket, "keys": keys.tobytes(), "line": index.astype(np.uint32).tobytes(), "nodes": nodes[own].tobytes()}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal own_bucket
            keys = np.concatenate([k for k, _, _ in held])
            shift = np.cumsum([0, *(len(n) for _, _, n in held)])
            line = np.concatenate([c + s for (_, c, _), s in zip(held, shift, strict=False)]).astype(np.uint32)
            nodes = np.concatenate([n for _, _, n in held])
            rows = []
            rank = np.empty(len(nodes), dtype=np.int64)
            rank[np.lexsort((nodes[:, 1], nodes[:, 0]))] = np.arange(len(nodes))
            order = np.lexsort((rank[line], keys))
            keys, line = keys[order], line[order]
            head = np.r_[True, keys[1:] != keys[:-1]]
            times = np.diff(np.r_[np.flatnonzero(head), len(keys)])
            often = np.repeat(times > common, times)
            if often.any():
                rows.append(packed(own_bucket, keys[often], line[often], nodes))
                own_bucket += 1
                keys, line = keys[~often | head], line[~often | head]
            bucket = (keys % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows.append(packed(int(bucket[order[a]]), keys[order[a:b]], line[order[a:b]], nodes))
            yield pa.RecordBatch.from_pylist(rows, schema=PACKS)

        for batch in batches:
            for _, raw, offsets in text_chunks(batch.column(0)):
                h, bounds = shingle_sets(raw, offsets, width)
                nodes = digests(h, bounds)
                new = []
                for k, d in enumerate(nodes):
                    name = d.tobytes()
                    if name not in seen:
                        seen.add(name)
                        new.append(k)
                if not new:
                    continue
                sizes = np.diff(bounds)[new]
                at = np.repeat(bounds[:-1][new] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                keys, line = plan.keys(h[at], np.r_[0, np.cumsum(sizes)])
                held.append((keys, line, nodes[new]))
                size += len(keys)
                if size >= FLUSH:
                    yield from flush()
                    held.clear()
                    size = 0
        if size:
            yield from flush()
        held.clear()
        seen.clear()
        give_back()

    def match(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(b, dtype=U64) for b in table["keys"].to_pylist()])
        packs = [np.frombuffer(b, dtype=U64).reshape(-1, 2) for b in table["nodes"].to_pylist()]
        shift = np.cumsum([0, *map(len, packs)])
        line = np.concatenate([np.frombuffer(b, dtype=np.uint32) + s for b, s in zip(table["line"].to_pylist(), shift, strict=False)])
        nodes, rank = np.unique(np.concatenate(packs), axis=0, return_inverse=True)
        line = rank.reshape(-1)[line]
        order = np.lexsort((line, keys))
        keys, line = keys[order], line[order]
        keep = np.r_[True, (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])]
        keys, line = keys[keep], line[keep]
        head = np.r_[True, keys[1:] != keys[:-1]]
        leader = line[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))]
        rest = ~head
        names = binaries(nodes)
        give_back()
        return pa.table([pa.array(keys[rest].view(np.int64)), names.take(pa.array(line[rest])), names.take(pa.array(leader[rest]))], schema=STARS)

    packed = texts.mapInArrow(pack, "bucket LONG, keys BINARY, line BINARY, nodes BINARY")
    return packed.groupBy("bucket").applyInArrow(match, "key LONG, node BINARY, leader BINARY")


def sets_of(table: pa.Table, width: int) -> tuple[pa.Table, list[np.ndarray]]:
    """The rows of `table` whose text has the set their `node` names, one per node and place, and these sets.

    Where rows repeat an id and a text, the join brings it more than once.
    """
    keep, sets, known = [], [], set()
    names = table["node"].to_pylist()
    places = list(zip(*(table[c].to_pylist() for c in ("block", "label", "chunk") if c in table.column_names), strict=True))
    for begin, raw, offsets in text_chunks(table["text"].combine_chunks()):
        h, bounds = shingle_sets(raw, offsets, width)
        for k, own in enumerate(binaries(digests(h, bounds)).to_pylist(), begin):
            if own == names[k] and (own, places[k]) not in known:
                known.add((own, places[k]))
                keep.append(k)
                sets.append(h[bounds[k - begin] : bounds[k - begin + 1]].copy())
    return table.select([c for c in table.column_names if c != "text"]).take(pa.array(keep, pa.int64())), sets


def block_links(members: DataFrame, width: int, num: int, den: int, tasks: int) -> DataFrame:
    """Links that span the components of each (block, chunk) of `members` (node, block, chunk, text)."""

    def run(table: pa.Table) -> pa.Table:
        table, all_sets = sets_of(table, width)
        nodes = table["node"].to_pylist()
        place = list(zip(table["block"].to_pylist(), table["chunk"].to_pylist(), strict=True))
        groups: dict[tuple, list[int]] = {}
        for k, p in enumerate(place):
            groups.setdefault(p, []).append(k)
        a, b = [], []
        for members_of in groups.values():
            sets = [all_sets[k] for k in members_of]
            order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), nodes[members_of[k]]))
            for x, y in Matrix(sets, num, den).link(order):
                a.append(nodes[members_of[x]])
                b.append(nodes[members_of[y]])
        del all_sets
        give_back()
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=LINKS)

    # small blocks share a task; one that fills a good part of a task has a group of its own
    own = F.concat(F.col("block"), F.encode(F.col("chunk").cast("string"), "utf-8"))
    shared = F.encode(F.pmod(F.xxhash64("block", "chunk"), F.lit(tasks)).cast("string"), "utf-8")
    spread = members.withColumn("task", F.when(F.col("weight") / F.col("chunks") > TASK_SHINGLES / 2, own).otherwise(shared)).drop("weight", "chunks")
    return spread.groupBy("task").applyInArrow(run, "a BINARY, b BINARY")


def probe_links(members: DataFrame, probes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links of probes (node, text, label, chunk) with the members (node, text) of their (label, chunk)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[bytes, bytes]] = []
        if left.num_rows and right.num_rows:
            (left, first), (right, second) = sets_of(left, width), sets_of(right, width)
            sets = first + second
            nodes = left["node"].to_pylist() + right["node"].to_pylist()
            inner = sorted(range(left.num_rows), key=lambda k: len(sets[k]))
            matrix = Matrix(sets, num, den)
            matrix.link(inner)
            out = [(nodes[x], nodes[y]) for x, y in matrix.link(list(range(left.num_rows, len(sets))), right.num_rows)]
        return pa.table([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], schema=LINKS)

    members, probes = members.toDF(*members.columns), probes.toDF(*probes.columns)  # columns of their own
    return members.groupBy("label", "chunk").cogroup(probes.groupBy("label", "chunk")).applyInArrow(lambda a, b: run(a, b), "a BINARY, b BINARY")


def with_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` with the label of their component under `links`; a node without a link is its own."""
    found = components(links).withColumnRenamed("component", "label")
    return nodes.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))


def set_links(
    texts: DataFrame, reps: DataFrame, width: int, num: int, den: int, block_shingles: int = BLOCK_SHINGLES, bucket_keys: int = BUCKET_KEYS
) -> DataFrame:
    """Links (a, b) that span every component of the similarity graph over different shingle sets.

    `reps` names each set: node, rep and mark (id and text hash of one row that has it), n_shingles.
    """
    total = reps.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, -(-int(total * 0.6) // bucket_keys))
    found = cut_lineage(stars(texts.select("text"), width, num, den, buckets))
    edges = found.select(F.col("node").alias("a"), F.col("leader").alias("b"))
    blocks = components(edges).withColumnRenamed("component", "block")
    placed = blocks.join(reps, "node")
    weights = placed.groupBy("block").agg(F.sum("n_shingles").alias("weight"))
    chunks = F.ceil(F.col("weight") / F.lit(block_shingles))
    chunked = cut_lineage(
        placed.join(weights.select("block", "weight", chunks.alias("chunks")), "block").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    )
    # The side without texts grows with the data; it is shuffled at every size, never broadcast.
    text = texts.select(F.col("id").alias("rep"), "mark", "text")
    members = chunked.hint("merge").join(text, ["rep", "mark"]).select("node", "block", "chunk", "chunks", "weight", "text")
    tasks = max(1, -(-total // TASK_SHINGLES))
    inner = cut_lineage(block_links(members, width, num, den, tasks))
    split = chunked.where("chunks > 1")
    if split.isEmpty():
        return inner
    return inner.unionByName(cross_links(texts, split, found, inner, width, num, den, block_shingles))


def in_parts(rows: DataFrame, by: str, block_shingles: int) -> DataFrame:
    """`rows` (node, n_shingles) with `parts`, as many as keep each part of a `by` to `block_shingles`, and the node's `part`."""
    parts = rows.groupBy(by).agg(F.ceil(F.sum("n_shingles") / F.lit(block_shingles)).alias("parts"))
    return rows.join(parts, by).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))


def meetings(open_runs: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, block, lo, hi): the pairs of parts in which a node meets all nodes of other labels that share an open key.

    A node goes to as many pairs as its block has parts, whatever the number of labels under a key.
    """
    runs = open_runs.join(placed.select("node", "block", "part"), "node")
    held = runs.groupBy("key", F.col("part").alias("other")).agg(F.min("label").alias("least"), F.max("label").alias("most"))
    met = runs.join(held, "key").where("least != label OR most != label")
    return met.select("node", "block", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).distinct()


def pair_links(members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links between the labels of each (block, lo, hi) of `members` (node, label, text)."""

    def run(table: pa.Table) -> pa.Table:
        table, sets = sets_of(table, width)
        nodes, labels = table["node"].to_pylist(), table["label"].to_pylist()
        matrix = Matrix(sets, num, den)
        first: dict[bytes, int] = {}
        matrix.parent = [first.setdefault(label, k) for k, label in enumerate(labels)]
        found = matrix.link(sorted(range(len(sets)), key=lambda k: (len(sets[k]), nodes[k])))
        del matrix, sets
        give_back()
        return pa.table([pa.array([nodes[x] for x, _ in found], pa.binary()), pa.array([nodes[y] for _, y in found], pa.binary())], schema=LINKS)

    return members.groupBy("block", "lo", "hi").applyInArrow(run, "a BINARY, b BINARY")


def cross_links(texts: DataFrame, split: DataFrame, found: DataFrame, inner: DataFrame, width: int, num: int, den: int, block_shingles: int) -> DataFrame:
    """Links between chunks of blocks too large for one task.

    First every set meets the leader of each key it shares, which joins large
    groups of near copies; the sets are dealt to parts of bounded shingles, and
    the leader goes to each.  Then only sets that share a key with a component
    that still differs meet: they are dealt to parts, and pairs of parts compared.
    """
    inside = split.select("node", "block", "rep", "mark", "n_shingles")
    text = texts.select(F.col("id").alias("rep"), "mark", "text")
    ours = found.join(inside.select("node"), "node", "left_semi")
    pairs = ours.select("node", F.col("leader").alias("label")).distinct()
    asked = cut_lineage(in_parts(pairs.join(inside, "node"), "label", block_shingles))
    asking = asked.join(text, ["rep", "mark"]).select("node", "label", F.col("part").alias("chunk"), "text")
    led = asked.select("label", "parts").distinct().join(inside.withColumnRenamed("node", "label"), "label").join(text, ["rep", "mark"])
    leaders = led.select(F.col("label").alias("node"), "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("chunk"), "text")
    stars_linked = cut_lineage(probe_links(leaders, asking, width, num, den))
    linked = inner.unionByName(stars_linked)

    labels = cut_lineage(with_labels(inside, linked))
    runs = ours.select("key", "node").unionByName(ours.select("key", F.col("leader").alias("node"))).distinct()
    seen = runs.join(labels.select("node", "label"), "node")
    mixed = seen.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    open_runs = cut_lineage(seen.join(mixed, "key", "left_semi"))
    placed = cut_lineage(in_parts(labels.join(open_runs.select("node").distinct(), "node", "left_semi"), "block", block_shingles))
    met = cut_lineage(meetings(open_runs, placed))
    members = met.join(placed.drop("block"), "node").join(text, ["rep", "mark"]).select("node", "label", "block", "lo", "hi", "text")
    return stars_linked.unionByName(cut_lineage(pair_links(members, width, num, den)))


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    num: int = 80,
    den: int = 100,
    block_shingles: int = BLOCK_SHINGLES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per row of `docs`: its id, n_shingles, component_id, component_key and the columns to `carry`.

    Rows link when den * |intersection| >= num * |union| of their sets of
    `width`-word shingles (see `shingles`).  component_id is the smallest id
    reachable by links, the row's own included.  Null and empty texts have an
    empty set and link with nothing, so their component is their own id.  Rows
    with equal sets share a component whatever their number; a null id is above
    every other.  Rows repeating an id are rows of their own.  An empty table
    gives an empty result.  component_key is 16 bytes that name the component
    also where ids repeat; it is null for an empty set.

    Equal sets are put together first, by a grouping that combines before the
    shuffle, so copies cost a row each and nothing more.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("text"))  # with the id: rows without an id, or that repeat one, meet their own set only
    carried = {f"_carry{k}": F.col(c) for k, c in enumerate(carry)}
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(c.alias(n) for n, c in carried.items()))
    keyed = keyed.withColumn("mark", F.xxhash64("text"))
    thin = cut_lineage(shingled(keyed, "text", width))
    full = thin.where("n_shingles > 0")
    one = full.groupBy("node").agg(F.min(F.struct("id", "mark")).alias("one"), F.max("n_shingles").alias("n_shingles"))
    reps = cut_lineage(one.select("node", F.col("one.id").alias("rep"), F.col("one.mark").alias("mark"), "n_shingles"))
    links = set_links(texts, reps, width, num, den, block_shingles)
    labelled = with_labels(reps.select("node", "rep"), links)
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = labelled.join(least, "label").select("node", "component_id", F.col("label").alias("component_key"))
    names = [id_col, *fresh(docs.select(id_col, *carry), "n_shingles", "component_id", "component_key"), *carry]
    linked = full.join(final, "node").select("id", "n_shingles", "component_id", "component_key", *carried)
    alone = thin.where("n_shingles = 0").select(
        "id", "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("binary").alias("component_key"), *carried
    )
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return linked.unionByName(alone).select(known("id"), "n_shingles", known("component_id"), "component_key", *carried).toDF(*names)
