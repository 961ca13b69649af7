"""The Jaccard join against a comparison of all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborist.llm.jaccard import Matrix, Parts, in_parts, jaccard_join, meetings, stars
from arborist.llm.shingles import digests, shingle_sets

SCHEMA = "doc_id LONG, text STRING, n_shingles STRING"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_force(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    top = 1 << 63
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), top), top if i is None else i)
    return sorted(((i, len(s), None if least[find(k)] == top else least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, groups=14):
    """Near copies at every distance from the threshold, sizes from one word to hundreds, shared passages."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(50)]
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 3, 5, 8, 12, 20, 34, 40, 60, 120, 400]))]
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 25)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [f"e{rng.randrange(9999)}"]
            if rng.random() < 0.2:
                words += passage
            texts.append((" " if rng.random() < 0.7 else "\n").join(words))
    texts += [None, "", "  \t", "Même École", "même école", "mÊme", "ONE two", "one TWO", "x" * 200_000]
    rng.shuffle(texts)
    return [(3 * k + 1, t) for k, t in enumerate(texts)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    return sorted((tuple(r)[:3] for r in jaccard_join(df, **kw).collect()), key=str)


@pytest.mark.parametrize("width,num,den,seed", [(4, 85, 100, 1), (5, 80, 100, 2)])
def test_against_all_pairs(spark, width, num, den, seed):
    rows = corpus(seed)
    assert run(spark, rows, width=width, num=num, den=den) == brute_force(rows, width, num, den)


def test_blocks_that_span_chunks(spark):
    rows = corpus(5)
    assert run(spark, rows, width=4, num=85, den=100, block_shingles=300) == brute_force(rows, 4, 85, 100)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "other words here now"), (None, None), (9, "other words here now"), (9, "z")]
    assert run(spark, rows, width=4, num=85, den=100) == brute_force(rows, 4, 85, 100)
    assert run(spark, [], width=4, num=85, den=100) == []


def test_no_pair_within_the_threshold_lacks_a_shared_key():
    rng = random.Random(3)
    for num, den in ((85, 100), (80, 100)):
        plan = Parts(num, den)
        for _ in range(400):
            n = rng.choice([4, 7, 10, 20, 31, 33, 36, 40, 41, 60, 130, 500, 3000])
            base = [rng.getrandbits(60) for _ in range(n)]
            cut, add = rng.randrange(0, n // 6 + 1), rng.randrange(0, n // 6 + 1)
            other = base[cut:] + [rng.getrandbits(60) for _ in range(add)]
            o = n - cut
            if o < 1 or den * o < num * (n + add) or other == base:
                continue
            keys = []
            for s in (base, other):
                h = np.array(sorted(s), dtype=np.uint64)
                keys.append(set(plan.keys(h, np.array([0, len(h)]))[0].tolist()))
            assert keys[0] & keys[1], (n, cut, add)


def test_shingle_sets_match_word_tuples():
    texts = [t or "" for _, t in corpus(9)]
    arr = pa.array(texts, pa.large_string())
    raw = np.frombuffer(arr.buffers()[2], np.uint8)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)
    h, bounds = shingle_sets(raw, offsets, 4)
    assert [len(shingles(t, 4)) for t in texts] == np.diff(bounds).tolist()
    for i in range(0, len(texts), 5):
        for j in range(len(texts)):
            a, b = set(h[bounds[i] : bounds[i + 1]].tolist()), set(h[bounds[j] : bounds[j + 1]].tolist())
            assert len(a & b) == len(shingles(texts[i], 4) & shingles(texts[j], 4))
    d = digests(h, bounds)
    assert (d[0] == d[0]).all() and len(np.unique(d, axis=0)) == len({frozenset(shingles(t, 4)) for t in texts})


def test_matrix_opens_few_groups_and_links_the_same():
    rng = random.Random(11)
    sets = []
    for g in range(8):
        base = [rng.getrandbits(60) for _ in range(100)]
        for _ in range(30):
            s = list(base)
            for _ in range(rng.randrange(14)):
                s[rng.randrange(100)] = rng.getrandbits(60)
            sets.append(np.unique(np.array(s, dtype=np.uint64)))
    m = Matrix(sets, 85, 100)
    m.link(sorted(range(len(sets)), key=lambda k: len(sets[k])))
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    ours = {}
    theirs = {}
    for k in range(len(sets)):
        ours.setdefault(m.find(k), set()).add(k)
        theirs.setdefault(find(k), set()).add(k)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_probes_and_meetings_are_bounded(spark):
    rows = spark.createDataFrame([(bytes([k // 256, k % 256]), b"leader", 10) for k in range(400)], "node BINARY, label BINARY, n_shingles LONG")
    sizes = [r["count"] for r in in_parts(rows, "label", 500).groupBy("label", "part").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 400 and max(sizes) < 100
    nodes = rows.select("node", F.lit(b"block").alias("block"), "n_shingles")
    met = meetings(rows.select(F.lit(7).alias("key"), "node", F.col("node").alias("label")), in_parts(nodes, "block", 1000))
    assert met.count() == 400 * 4 and met.select("lo", "hi").distinct().count() == 10


def test_unlinked_sets_and_near_copies_without_ids_across_parts(spark):
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = [(None if k % 3 else k, " ".join([f"u{k}x{j}" for j in range(30)] + passage)) for k in range(24)]
    base = [f"b{k}" for k in range(150)]
    for k in range(24):
        words = list(base)
        words[rng.randrange(150)] = f"e{k}"
        rows.append((None if k % 3 else 100 + k, " ".join(words + (passage[:20] if k % 2 else []))))
    assert run(spark, rows, width=4, num=80, den=100, block_shingles=400) == brute_force(rows, 4, 80, 100)


def test_stars_made_within_tasks_join_the_same_sets(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    texts = spark.createDataFrame([(f"a{k} b{k} c{k} d{k} {passage}",) for k in range(90)] + [(f"{passage} e{k}",) for k in range(30)], "text STRING").repartition(3)
    by_key = []
    for common in (1 << 30, 2):
        found = stars(texts, 4, 80, 100, 4, common).collect()
        joined: dict[int, list[set]] = {}
        for r in found:
            a, b = bytes(r["node"]), bytes(r["leader"])
            groups = joined.setdefault(r["key"], [])
            near = [g for g in groups if a in g or b in g]
            joined[r["key"]] = [g for g in groups if g not in near] + [set().union({a, b}, *near)]
        assert all(len(groups) == 1 for groups in joined.values())
        by_key.append({k: g[0] for k, g in joined.items()})
        most = max(len([1 for r in found if r["key"] == k]) for k in joined)
        assert most <= 119 + 3
    assert by_key[0] == by_key[1] and max(map(len, by_key[0].values())) > 100
