"""The training-data operators on small tables, against brute force, round trips or libraries."""

import base64
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pytest

from arborist.llm import bpe, curriculum, quality, sharding, topk, warc, wrappers
from arborist.llm.chat import CLOSE, GUARD, OPEN, rotate_perspectives
from arborist.llm.common import components
from arborist.llm.exact_dedup import exact_dedup
from arborist.session import scratch
from pyspark.sql import functions as F

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, size STRING"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "clash") for i, t, s in rows], DOCS)


# components


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(parent)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == want


# exact dedup

TEXTS = [(5, "a", "s"), (9, "a", "s"), (7, "b", None), (1, None, "s"), (2, "", "s"), (None, "a", "s"), (3, "A", "s"), (9, "a", "s"), (4, "x" * 50_000, "s"), (6, "x" * 50_000, "s")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_keeps_the_largest_id(spark, weak):
    digest = (lambda t: F.unhex(F.lit("00"))) if weak else None
    found = exact_dedup(docs(spark, TEXTS), **({"digest": digest} if weak else {})).collect()
    groups = {}
    for i, t, _ in TEXTS:
        groups.setdefault(t or "", []).append(i)
    assert len(found) == len(TEXTS)
    for r in found:
        own = groups[r["text"] or ""]
        assert r["group_size"] == len(own) and r["keep_id"] == max(i for i in own if i is not None)
        assert r["size"] == "clash"
    kept = [(r["doc_id"], r["text"] or "") for r in found if r["kept"]]
    assert sorted(kept) == sorted((max(i for i in v if i is not None), t) for t, v in groups.items())


def test_exact_dedup_state_spans_micro_batches(spark, tmp_path):
    rows = [(k, f"t{k % 7}", "s") for k in range(60)]
    docs(spark, rows).repartition(6).write.parquet(str(tmp_path / "d"))
    folder = scratch(spark, "test-dedup")
    found = exact_dedup(spark.read.parquet(str(tmp_path / "d")), folder=folder, batches=3).collect()
    assert {r["keep_id"] for r in found} == set(range(53, 60)) and sum(r["kept"] for r in found) == 7
    states = spark.read.parquet(f"{folder}/state").select("epoch", "digest", "group_size").collect()
    last = {bytes(r["digest"]): r["group_size"] for r in sorted(states)}
    # later batches count on from the kept state
    assert len({r["epoch"] for r in states}) >= 3 and sum(last.values()) == 60 < sum(r["group_size"] for r in states)
    assert exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_goes_on_with_its_state(spark, tmp_path):
    path, folder = str(tmp_path / "d"), scratch(spark, "test-dedup")
    docs(spark, [(k, f"t{k % 7}", "s") for k in range(30)]).write.parquet(path)
    exact_dedup(spark.read.parquet(path), folder=folder).count()
    docs(spark, [(k, f"t{k % 9}", "s") for k in range(30, 40)] + [(2, "t0", "s")]).write.mode("append").parquet(path)
    found = exact_dedup(spark.read.parquet(path), folder=folder).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["text"], []).append(r)
    assert len(found) == 41
    for own in groups.values():
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(max(r["doc_id"] for r in own), len(own))}
        assert sum(r["kept"] for r in own) == 1
    assert spark.read.parquet(f"{folder}/feed").count() == 41


def test_exact_dedup_keeps_the_named_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a", "x", "y"), (2, "a", "x", "y"), (3, "b", "x", "y")], "doc_id LONG, text STRING, k STRING, _t STRING")
    for digest in (None, lambda t: F.unhex(F.lit("00"))):
        found = exact_dedup(rows, keep=["doc_id", "k", "_t"], **({"digest": digest} if digest else {}))
        assert found.columns == ["doc_id", "k", "_t", "keep_id", "keep_locator", "group_size", "kept"]
        assert sorted((r["doc_id"], r["k"], r["_t"], r["keep_id"], r["group_size"]) for r in found.collect()) == [(1, "x", "y", 2, 2), (2, "x", "y", 2, 2), (3, "x", "y", 3, 1)]


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return path, raw, public_tokenizers.PATTERN, library


def test_bpe_equals_the_library(vocabulary):
    _, raw, pattern, library = vocabulary
    own, rng = bpe.Codec(raw, pattern), random.Random(2)
    letters = [*"abcdeéßñ漢字🙂 \t\n\r\x0b\x1c\x1f\x85\xa0 　'sdtl0123456789!?…́​", "'ll", "  ", "<|endoftext|>", "﻿"]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        ids = [i for p in own.encode([text])[0] for i in p[0]]
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()
    long = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    assert list(own.merge_one(long.encode())) == library.encode_ordinary(long)
    words = ["".join(rng.choice("etaoinshé") for _ in range(rng.randint(2, 15))).encode() for _ in range(200)]
    assert own.merge_many(words, 32) == [own.merge_one(w) for w in words]


def test_bpe_rows(spark, vocabulary):
    path, _, pattern, library = vocabulary
    found = bpe.bpe_round_trip(docs(spark, TEXTS), path, pattern, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        ids = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(docs(spark, []), path, pattern).columns[-3:] == ["n_tokens", "ids", "decoded"]


# WARC

PAGES = [(1, "http://a.example/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nv", None), (4, "u", ""), (5, "u", "z" * 300_000), (2, "u", "<p>é</p>"), (None, "u", "only\r\n\r\nbreaks"), (8, "u", "w")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id LONG, url STRING, html STRING, offset STRING")


@pytest.mark.parametrize("file_bytes", [1, 1 << 20])
def test_warc_round_trip(spark, file_bytes):
    folder = scratch(spark, "test-warc")
    index = warc.archive_pages(pages(spark, PAGES), folder, file_bytes=file_bytes)
    found = warc.read_records(index, f"{folder}/records").collect()
    assert len(found) == len(PAGES)
    by_payload = {}
    for p, _, h in PAGES:
        by_payload.setdefault((h or "").encode(), []).append(p)
    for payload, ids in by_payload.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        own = [r for r in found if r["payload_digest"] == digest]
        keeper = max((i for i in ids if i is not None), default=None)
        responses = [r for r in own if r["record_type"] == "response"]
        assert len(own) == len(ids) and len(responses) == 1 and responses[0]["page_id"] == keeper
        assert bytes(responses[0]["payload"]) == payload and {r["payload_bytes"] for r in own} == {len(payload)}
        assert all(r["refers_to"] == keeper and r["payload"] is None for r in own if r["record_type"] == "revisit")
    assert warc.archive_pages(pages(spark, []), scratch(spark, "test-warc")).count() == 0


def test_warc_members_stand_alone_and_damage_is_seen(spark):
    folder = scratch(spark, "test-warc")
    index = warc.archive_pages(pages(spark, PAGES), folder, min_payload=10).collect()
    assert sum(r["record_type"] == "revisit" for r in index) == 0 or all(r["length"] > 0 for r in index)
    system, root = warc.place(f"{folder}/records")
    for r in index:
        with system.open_input_file(f"{root}/{r['archive']}") as f:
            f.seek(r["offset"])
            assert zlib.decompress(f.read(r["length"]), 31).startswith(b"WARC/1.1\r\n")
    with pytest.raises(ValueError):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"])))


def test_archives_are_dealt_to_a_task_each(spark):
    rows = spark.createDataFrame([(f"archive-{k % 24}", k) for k in range(24 * 30)], "archive STRING, record INT").repartition(3)
    tasks = warc.per_archive(rows).select("archive", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == 24 == len({r["task"] for r in tasks})
    folder = scratch(spark, "test-warc")
    many = [(k, f"https://x.example/{k}", f"page {k} " * 30) for k in range(60)]
    index = warc.archive_pages(pages(spark, many), folder, file_bytes=600)
    assert index.select("archive").distinct().count() >= 20
    found = warc.read_records(index, f"{folder}/records")
    assert found.rdd.getNumPartitions() >= 20 and sorted(r["page_id"] for r in found.collect()) == list(range(60))


# Sharding


def test_sharding_law_slots_and_files(spark, tmp_path):
    rows = [(k, f"text {k % 40}" * (1 + k % 5), "s") for k in range(401)] + [(None, None, None), (3, "dup", "s"), (3, "dup", "s")]
    table = docs(spark, rows)
    first = sharding.external_shuffle(table, 16, bucket_bytes=900)
    sharding.write_shards(first, str(tmp_path / "s"))
    found = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in found))) == sorted(map(str, ((i, t) for i, t, _ in rows)))
    shards = {}
    for r in found:
        assert r["_size"] == len((r["text"] or "").encode()) + 1 and r["size"] == "clash"
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(shards) == list(range(16)) and {len(v) for v in shards.values()} <= {404 // 16, 404 // 16 + 1}
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    again = {(r["shard"], r["slot"]): r["doc_id"] for r in sharding.external_shuffle(table.repartition(3), 16, bucket_bytes=900).collect()}
    assert again == {(r["shard"], r["slot"]): r["doc_id"] for r in found}
    assert sharding.external_shuffle(docs(spark, [])).count() == 0
    assert sharding.external_shuffle(docs(spark, [(1, "a", "s")])).count() == 1


def test_sharding_moves_a_text_once(spark):
    # a table of unknown size: the join with a row per bucket shuffles no text
    plan = sharding.external_shuffle(docs(spark, [(1, "a", "s"), (2, "b", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_fisher_yates_is_a_permutation_and_roughly_uniform():
    assert sorted(sharding.fisher_yates(1000, 1, 2)) == list(range(1000))
    seen = {tuple(sharding.fisher_yates(3, 5, b)) for b in range(200)}
    assert len(seen) == 6 and list(sharding.fisher_yates(0, 1, 1)) == []


# Top-k


def brute_top_k(rows, k, every):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q % every == 0:
            hits = sorted((-sum(map(int.__mul__, x, y)), i) for b, (i, y) in enumerate(ok) if a != b)[:k]
            out.extend((q, r + 1, i, -s) for r, (s, i) in enumerate(hits))
    return sorted(out)


@pytest.mark.parametrize("size", [0, 1, 12, 300])
def test_exact_top_k(spark, size):
    rng = np.random.default_rng(size)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6) + (k % 3)]) for k in range(size)]
    if size > 12:
        rows += [(20, rows[20][1]), (40, None), (60, [0.1, None, 0.2]), (None, [1.0] * 6), (80, [float("nan")] * 6), (100, [float("inf")] * 6), (120, [0.5, 0.5]), (140, [])]
        rows += [(1000 + k, [1.0] * 6) for k in range(30)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id LONG, embedding ARRAY<FLOAT>, rank INT")
    found = topk.exact_top_k(table, 7, 20, block_rows=40, group_rows=4, pivots=5).collect()
    assert sorted(map(tuple, found)) == brute_top_k(rows, 7, 20)


def test_cover_tree_invariants_and_pruned_search():
    rng = np.random.default_rng(1)
    points = np.floor(np.concatenate([rng.normal(c, 1, (300, 4)) for c in (0, 40, 80, 120)]) * 8).astype(np.int64)
    tree = topk.build(np.arange(1200), np.arange(1200), points, 16)
    assert sorted(tree.rows) == list(range(1200))
    for n in range(len(tree.nodes)):
        d = np.linalg.norm(tree.floats[tree.begin[n] : tree.end[n]] - tree.floats[tree.centre[n]], axis=1)
        assert d.max() <= tree.radius[n] and tree.begin[n] <= tree.centre[n] < tree.end[n]
    queries = topk.build(np.arange(5000, 5050), np.arange(50), points[rng.integers(0, 1200, 50)], 8)
    best = topk.search(queries, tree, 5).held
    for q in range(50):
        s = tree.points @ queries.points[q]
        want = sorted(zip((-s).tolist(), tree.ids.tolist(), strict=True))[:5]
        assert [(-r["s"], r["i"]) for r in best[best["q"] == q]] == want


# Quality


def test_quality_separates_and_scores_everything(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "river", "of", "stone", "and", "light", "walks"]) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(20, 200))) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW$$$", "FREE%%", "CLICK###"]) for _ in range(rng.randint(20, 200))) for _ in range(60)]
    rows = [(k, t, "s") for k, t in enumerate(good + bad)] + [(900, "", "s"), (901, None, "s"), (None, "the river", "s"), (902, "x" * 100_000, "s")]
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k in range(210)] + [(900, None, None), (None, 1, 0), (5, 1, 0)], "doc_id LONG, quality INT, toxic INT")
    model = quality.quality_model(docs(spark, rows), labels)
    found = quality.classify(docs(spark, rows), model).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 210 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["predicted"] == int(r["doc_id"] < 150) for r in held) >= 0.95 * len(held) > 30


def test_quality_fit_equals_plain_numpy_and_needs_both_classes(spark):
    rng = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    x, y = rng.normal(0, 1, (80, d)), np.r_[np.zeros(30, int), np.ones(50, int)]
    table = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(y, x, strict=True)], "label INT, features ARRAY<DOUBLE>")
    model = quality.fit(table, "label", shrinkage=0.1)
    logs = []
    pooled = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1)) / 80
    for c in (0, 1):
        own, n = x[y == c], (y == c).sum()
        a = 0.1 + 0.9 * d / (d + n)
        cov = (1 - a) * np.cov(own.T, bias=True) + a * pooled + 1e-4 * (np.diag(np.diag(pooled)) + np.eye(d))
        z = x - own.mean(0)
        logs.append(np.log(n / 80) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    assert np.allclose(model.log_odds(x), logs[1] - logs[0])
    assert quality.fit(table.where("label = 1"), "label") is None
    assert quality.classify(docs(spark, TEXTS), None).select("score").distinct().collect()[0][0] == 0.5


# Curriculum


def water(sizes, weights, cap):
    """Targets by sharing the excess again and again."""
    total, out, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free and left > 1e-9:
        unit = left / sum(weights[k] for k in free)
        over = {k for k in free if unit * weights[k] > cap * sizes[k] + 1e-9}
        if not over:
            for k in free:
                out[k] = unit * weights[k]
            break
        for k in over:
            out[k] = float(cap * sizes[k])
            left -= out[k]
        free -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 50, 500, 5000]) for _ in range(rng.randint(1, 9))]
    names = [chr(97 + k) for k in range(len(sizes) - 1)] + [None]
    table = spark.createDataFrame([(n, s, 1) for n, s in zip(names, sizes, strict=True)], "source STRING, source_size LONG, rows LONG")
    got = {r["source"]: r["target"] for r in curriculum.source_targets(table).collect()}
    want = water(sizes, [k % 3 + 1 for k in range(len(sizes))], 3)
    assert all(abs(got[n] - w) < 1e-6 * max(1, w) for n, w in zip(names, want, strict=True)) or sum(sizes) == 0


def test_curriculum_takes_whole_documents_near_the_targets(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(600)]
    rows += [(None, None, "a"), (5, "w w w", "b"), (5, "w w w", "b")]
    one = curriculum.curriculum_mix(docs(spark, rows), rows_per_cell=50)
    found = one.collect()
    assert len(found) == len(rows) and all(r["size"] == "clash" and r["taken"] == r["_size"] * r["copies"] for r in found)
    for s in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 40 and {r["source_size"] for r in own} == {sum(r["_size"] for r in own)}
    assert max(r["copies"] for r in found) <= 3 and all(len(r["positions"]) == r["copies"] for r in found)
    first = [r["positions"][0] if r["positions"] else 2.0 for r in found]
    assert first == sorted(first) and all(p == sorted(p) and all(0 <= x <= 1 for x in p) for p in (r["positions"] for r in found))
    again = curriculum.curriculum_mix(docs(spark, rows).repartition(5), rows_per_cell=7).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["taken"], r["positions"])
    assert sorted(map(key, again)) == sorted(map(key, found))
    assert curriculum.training_order(one).count() == sum(r["copies"] for r in found)
    assert curriculum.curriculum_mix(docs(spark, [])).count() == 0


def test_due_time_inverts_the_integral(spark):
    for knots in curriculum.SCHEDULES.values():
        shares = np.linspace(0, 1, 21)
        got = [r[0] for r in spark.createDataFrame([(float(s),) for s in shares], "s DOUBLE").select(curriculum.due_time(F.col("s"), knots)).collect()]
        grid = np.linspace(0, 1, 20_001)
        weight = np.interp(grid, *zip(*knots, strict=True))
        area = np.r_[0, np.cumsum((weight[1:] + weight[:-1]) / 2)]
        assert np.allclose(got, np.interp(shares, area / area[-1], grid), atol=1e-3)


# Chat


def test_every_participant_is_the_assistant_once(spark):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", f"yo {OPEN}"), (1, 2, "ann", "é"), (1, 2, "ann", "é"), (2, None, None, None), (None, 5, "x\ny", ""), (1, 300, "cy", "late")]
    table = spark.createDataFrame([(*t, "e") for t in turns], "conv_id LONG, turn LONG, role STRING, text STRING, mask STRING")
    found = {(r["conv_id"], r["speaker"], r["part"]): r for r in rotate_perspectives(table).collect()}
    assert set(found) == {(1, s, p) for s in ("ann", "bob", "cy") for p in (0, 1)} | {(2, "unknown", 0), (None, "x\ny", 0)}
    ann = found[1, "ann", 0]
    assert ann["rendered"] == f"{OPEN}assistant\nhi{CLOSE}\n{OPEN}user name=bob\nyo <{GUARD}|im_start|>{CLOSE}\n" + "\n".join([f"{OPEN}assistant\né{CLOSE}"] * 2)
    assert [ann["rendered"][s["begin"] : s["end"]] for s in ann["mask"]] == [f"hi{CLOSE}", f"é{CLOSE}", f"é{CLOSE}"]
    assert found[1, "ann", 1]["mask"] == [] and found[1, "cy", 1]["n_turns"] == 1 and found[1, "cy", 0]["n_turns"] == 4
    assert rotate_perspectives(table.limit(0)).count() == 0


# HTML


def site(host, k, body):
    menu = "".join(f"<li><a href='/{n}'>menu {n}</a></li>" for n in range(4))
    return (k, f"https://{host}/{k}", f"<html><head><title>T{k}</title><script>var a='</p>';</script></head><body>{body.replace('@menu', f'<ul class=menu>{menu}</ul>')}</body></html>")


def test_main_text_with_and_without_article_markup(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet nunc".split()) for _ in range(n))
    rows, want = [], {}
    for k in range(12):
        paragraphs = [f"{k} {words(30)}" for _ in range(1 + k % 4)]
        marked = f"<nav>@menu</nav><div class='ad'>{words(5)}</div><article><h1>Head &amp; {k}</h1>" + "".join(f"<p><b>{p}<br>" if k == 3 else f"<p>{p}</p>" for p in paragraphs)
        rows.append(site("a.example", k, marked + "<aside>side</aside><div class=comments><p>me too</p></div></article><footer>&copy; foot</footer>"))
        want[k] = "\n".join([f"Head & {k}", *paragraphs])
        plain = "@menu<div id='page1'><div class='wide'>" + "".join(f"<h2>Part {k}{j}</h2><p>{p}</p>" for j, p in enumerate(paragraphs))
        rows.append(site("B.example", 100 + k, plain + "</div><div class='low'>Always the same line</div></div><form>go<input></form>"))
        want[100 + k] = "\n".join(x for j, p in enumerate(paragraphs) for x in (f"Part {k}{j}", p))
    rows += [(200, None, None), (201, "not a url", ""), (202, "https://deep.example/", "<div>" * 5000 + "deep" + "</div>" * 5000), (203, "https://odd.example", "<p <a 'x>tail &am &#233; <!-- open")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id LONG, url STRING, html STRING, main_text STRING")
    found = {r["page_id"]: r["_main_text"] for r in wrappers.extract_main_text(table).collect()}
    assert len(found) == len(rows) and {k: found[k] for k in want} == want
    assert found[200] == "" and found[201] == "" and found[202] == "deep"
    assert wrappers.extract_main_text(table.limit(0)).count() == 0


def test_wrapper_has_optional_and_repeated_groups_and_slots():
    one, _ = wrappers.page_tree("<body><dl><dt>a</dt><dd>1</dd><dt>b</dt><dd>2</dd></dl><p>same</p></body>")
    two, _ = wrappers.page_tree("<body><dl><dt>c</dt><dd>3</dd></dl><hr><h2>new</h2><p>same</p></body>")
    w = wrappers.merge(one, two)
    body = w.children[0]
    assert [c.label for c in body.children] == ["dl", "h2", "p"] and [c.pages for c in body.children] == [2, 1, 2]
    (group,) = body.children[0].children
    assert group.label == "(dt|dd)" and group.repeats and group.pages == 2 and group.children[0].children[0].constant == ""
    assert body.children[2].children[0].constant not in ("", None)
    assert json.dumps(wrappers.Node.unpack(w.pack()).pack()) == json.dumps(w.pack())
    groups = [next(x for x in tree.pack() if x[0] == "(dt|dd)") for tree in (w, wrappers.merge(two, one))]
    assert groups[0] == groups[1]


def test_bpe_merges_a_piece_that_is_met_again_once(monkeypatch):
    ranks = b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 256\n"
    codec = bpe.Codec(ranks, r"[a-z]+|\s+")
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 2)
    merged = []
    monkeypatch.setattr(codec, "merge_one", lambda raw, merge=codec.merge_one: merged.append(raw) or merge(raw))
    for k in range(20):  # the cache is full after each turn; what every turn has in it stays
        ((often, _), *_), *_ = codec.encode(["abc " + "x" * (k + 2) + " y" + "z" * (k + 1)])
        assert often == (256, 99)
    assert merged.count(b"abc") == 1 and len(codec.cache) + len(codec.before) < 12
