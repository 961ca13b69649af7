"""Graph work on the rows of one small project, inside a task.

Spark brings a project's rows together; a function here works on them and gives
rows back.  What is small is said in `traverse`, whose rounds do the same work,
with the same results, on projects of any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The names in the columns, in their order, and each column as places among them (-1: null)."""
    texts = pa.chunked_array([chunk for c in columns for chunk in c.chunks], columns[0].type).combine_chunks().dictionary_encode()
    order = pc.sort_indices(texts.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    places = rank[texts.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    return texts.dictionary.take(pa.array(order)), np.split(places, np.cumsum([len(c) for c in columns])[:-1])


def communities(key: tuple[pa.Scalar], table: pa.Table, words: int, rounds: int, resolution: float) -> pa.Table:
    """(project, file, community) after the moves of `traverse.community_members`, from edges (project, src, dst) with the ends' halves."""
    names, (a, b) = coded(table["src"], table["dst"])
    n, m = len(names), table.num_rows
    k = np.bincount(a[a >= 0], minlength=n) + np.bincount(b[b >= 0], minlength=n)
    turns = np.zeros((words, n), np.int64)
    for end, at in (("src", a), ("dst", b)):
        for w in range(words):
            turns[w, at[at >= 0]] = table[f"{end}_turn{w}"].to_numpy()[at >= 0]
    both = (a >= 0) & (b >= 0)
    near, far = np.divmod(np.unique(np.concatenate([a[both] * n + b[both], b[both] * n + a[both]])), max(n, 1))
    weight = k / (2 * m) * resolution
    c = np.arange(n)

    def moves(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The files `who` that gain by moving, and where to."""
        sigma = np.bincount(c, weights=k, minlength=n)
        on = who[near]
        keys, k_in = np.unique(near[on] * n + c[far[on]], return_counts=True)
        if not len(keys):
            return keys, keys
        node, to = np.divmod(keys, n)
        own = to == c[node]
        gain = np.where(own, k_in - (sigma[to] - k[node]) * weight[node], k_in - sigma[to] * weight[node])
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        top = np.maximum.reduceat(gain, first)
        best = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(first, len(node)))))
        movers, least = np.unique(node[best], return_index=True)
        stay = -(sigma[c] - k) * weight
        stay[node[own]] = gain[own]
        better = top > stay[movers] + 1e-12
        return movers[better], to[best[least]][better]

    for r in range(rounds):
        movers, to = moves((turns[r // 64] >> (r % 64)) & 1 == 1)
        if not len(movers) and not len(moves(np.ones(n, bool))[0]):
            break
        c[movers] = to
    least = np.full(n, n)
    np.minimum.at(least, c, np.arange(n))
    return pa.table({"project": pa.repeat(key[0], n), "file": names, "community": names.take(pa.array(least[c]))})


def tour(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
    """(project, file, need, out, depth, last) of the listed files: those with `listed`, in column src; the other rows are edges."""
    names, (a, b) = coded(table["src"], table["dst"])
    n, listed = len(names), np.zeros(len(names), bool)
    file = table["listed"].to_numpy()
    listed[a[file]] = True
    a, b = np.divmod(np.unique((a[~file] + 1) * (n + 1) + b[~file] + 1), n + 1)
    need, out = np.bincount(b, minlength=n + 1)[1:], np.bincount(a, minlength=n + 1)[1:]
    known = (a > 0) & (b > 0)
    a, b = a[known] - 1, b[known] - 1
    left, depth, level = need.copy(), np.full(n, -1), 0
    ready = listed & (need == 0)
    while ready.any():
        depth[ready] = level
        level += 1
        left -= np.bincount(b[ready[a]], minlength=n)
        ready = listed & (left == 0) & (depth < 0)
    at = np.flatnonzero(listed)
    return pa.table({
        "project": pa.repeat(key[0], len(at)), "file": names.take(pa.array(at)), "need": need[at], "out": out[at],
        "depth": pa.array(depth[at].astype(np.int32), mask=depth[at] < 0), "last": np.full(len(at), level, np.int32),
    })


def least_paths(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
    """(project, src, dst, path) of the wanted pairs with a way: those with `asked`; the other rows are edges."""
    back: dict[str, list[str]] = {}
    wanted: dict[str, set[str]] = {}
    for a, b, asked in zip(*(table[c].to_pylist() for c in ("src", "dst", "asked"))):
        if asked:
            wanted.setdefault(b, set()).add(a)
        else:
            back.setdefault(b, []).append(a)
    found = []
    for end, starts in wanted.items():
        # of the files one level nearer to the end, the least is the next
        after, level, left = {end: None}, [end], set(starts)
        while level and left:
            reached: dict[str, str] = {}
            for b in level:
                for a in back.get(b, ()):
                    if a not in after and b < reached.get(a, b + "\0"):
                        reached[a] = b
            after |= reached
            level = list(reached)
            left.difference_update(level)
        for start in starts & after.keys():
            path = [start]
            while path[-1] != end:
                path.append(after[path[-1]])
            found.append((start, end, path))
    src, dst, path = zip(*found) if found else ((), (), ())
    return pa.table({
        "project": pa.repeat(key[0], len(src)), "src": pa.array(src, pa.string()), "dst": pa.array(dst, pa.string()),
        "path": pa.array(path, pa.list_(pa.string())),
    })


def components(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
    """(project, node, component, inner) of components with more than one file, from edges (project, src, dst).

    `inner` are the files of its component that a file imports.  One walk goes ahead and one back.
    """
    ahead: dict[str, set[str]] = {}
    back: dict[str, list[str]] = {}
    for a, b in zip(table["src"].to_pylist(), table["dst"].to_pylist()):
        ahead.setdefault(a, set()).add(b)
        back.setdefault(b, []).append(a)
    # only files with a way in and a way out lie on a cycle
    able = ahead.keys() & back.keys()
    left: list[str] = []
    seen: set[str] = set()
    for root in able:
        if root in seen:
            continue
        seen.add(root)
        walk = [(root, iter(ahead[root]))]
        while walk:
            for b in walk[-1][1]:
                if b in able and b not in seen:
                    seen.add(b)
                    walk.append((b, iter(ahead[b])))
                    break
            else:
                left.append(walk.pop()[0])
    rows: list[tuple[str, str, list[str]]] = []
    seen = set()
    for root in reversed(left):
        if root in seen:
            continue
        seen.add(root)
        part = [root]
        for node in part:
            for a in back[node]:
                if a in able and a not in seen:
                    seen.add(a)
                    part.append(a)
        if len(part) > 1:
            least, inside = min(part), set(part)
            rows += [(node, least, list(ahead[node] & inside - {node})) for node in part]
    node, component, inner = zip(*rows) if rows else ((), (), ())
    return pa.table({
        "project": pa.repeat(key[0], len(node)), "node": pa.array(node, pa.string()), "component": pa.array(component, pa.string()),
        "inner": pa.array(inner, pa.list_(pa.string())),
    })
