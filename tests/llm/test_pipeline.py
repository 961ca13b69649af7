"""The pipeline against a plain version of its stages, on a small corpus."""

import hashlib
import random

import corpus_pipeline
from arborist.llm.curriculum import curriculum_mix
from arborist.llm.quality import classify, quality_model
from tests.llm.test_jaccard import brute_force

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def corpus():
    rng = random.Random(8)
    words = "the river of stone and light walks over old hills where rain has been for days".split()
    rows = []
    for k in range(120):
        text = ". ".join(" ".join(rng.choice(words) + rng.choice(["", "", "s"]) for _ in range(rng.randint(4, 14))) for _ in range(rng.randint(1, 9))) + "."
        rows.append((k, text, "en", f"s{k % 4}" if k % 9 else None, len(text)))
    for k in range(120, 150):  # exact copies, then near ones
        text = rows[rng.randrange(40)][1]
        rows.append((k, text if k % 2 else text + " tail", "en", "s1", len(text)))
    for k in range(150, 190):
        text = " ".join(rng.choice(["BUY!!", "NOW$$$", "FREE%%", "CLICK###"]) for _ in range(rng.randint(20, 90)))
        rows.append((k, text, "en", "s2", len(text)))
    return [*rows, (None, "a row without a name", "en", "s3", None), (500, None, None, None, None), (501, "", "en", "s0", 0)]


def test_stages_one_by_one(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{sf}/documents.parquet")
    labels = [(k, int(k < 150), 0) for k in range(190)]
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        got.append(docs.collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mix", "encode"]
    assert all(spark.read.parquet(f"{sf}/{k}").columns == [f.split()[0] for f in SCHEMA.split(", ")] for k in range(4))

    table = spark.createDataFrame(corpus(), SCHEMA)
    model = quality_model(table, spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT"))
    good = {(r["doc_id"], r["text"]) for r in classify(table, model).where("predicted = 1").collect()}
    assert {(r["doc_id"], r["text"]) for r in got[0]} == good
    assert not any(150 <= (i or 0) < 190 for i, _ in good) and sum((i or 999) < 150 for i, _ in good) > 140

    last = {}
    for i, t in good:
        last[t or ""] = max(last.get(t or "", (False, 0, i)), (i is not None, i or 0, i))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got[1]) == sorted((str(v[2]), t) for t, v in last.items())

    rows = [(r["doc_id"], r["text"]) for r in got[1]]
    least = {c for i, n, c in brute_force(rows, 5, 80, 100)}
    assert sorted(map(str, (r["doc_id"] for r in got[2]))) == sorted(map(str, least))
    assert len(got[2]) < len(got[1])

    kept = spark.read.parquet(f"{sf}/2")
    plan = {r["doc_id"]: r["copies"] for r in curriculum_mix(kept).collect()}
    seen = {}
    for r in got[3]:
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {i: c for i, c in plan.items() if c}

    texts = {r["doc_id"]: r["text"] or "" for r in got[3]}
    assert len(got[4]) == len(got[3])
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in got[4])


def test_run_on_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    sf = str(tmp_path)
    names = ["predicted", "score", "kept", "keep_id", "_place", "component_key", "copies", "size", "k", "_t"]
    rows = [(*r, *(f"{n}{r[0]}" for n in names)) for r in corpus()]
    schema = ", ".join([SCHEMA, *(f"{n} STRING" for n in names)])
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, int(k < 150), 0) for k in range(190)], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        assert docs.count() > 20 and all(r[n] == f"{n}{r['doc_id']}" for r in docs.collect() for n in names)
