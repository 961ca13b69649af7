import datetime as dt

from pyspark.sql import functions as F

from arborist.functions.paths import glob_to_regex
from arborist.operators import coverage as cv
from arborist.operators import tracking as tr

META = "project string, path string, git_commit string, updated timestamp, source_files array<string>, source_globs array<string>"
CHANGES = "project string, ref string, path string, status string, seq bigint"
FILES = "project string, path string, mtime timestamp"
OLD, NEW = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)


def meta(spark, *rows):
    return spark.createDataFrame([("p", path, ref, OLD, fs, gs) for path, ref, fs, gs in rows], META)


def files(spark, *rows):
    return spark.createDataFrame([("p", path, m) for path, m in rows], FILES)


def changes(spark, *rows):
    return spark.createDataFrame([("p", ref, path, "modified", i) for i, (ref, path) in enumerate(rows)], CHANGES)


def plan(df):
    return {r["path"]: (r["status"], r["reasons"]) for r in df.collect()}


def test_globs(spark):
    cases = [
        ("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/x/a.ts", False), ("src/**/*.ts", "src/x/a.ts", True),
        ("src/**/*.ts", "src/a.ts", True), ("a?.ts", "ab.ts", True), ("{a,b}.ts", "b.ts", True), ("[ab].ts", "c.ts", False),
        ("a.ts", "axts", False), ("{open", "{open", True), ("x[", "x[", True), ("**", "any/thing", True), ("[].ts", "a.ts", False),
    ]
    df = spark.createDataFrame(cases, "glob string, file string, want boolean").withColumn("rx", glob_to_regex(F.col("glob")))
    assert [r["glob"] for r in df.where("(file RLIKE rx) <> want").collect()] == []
    pairs = df.where("want").select(F.lit("p").alias("project"), "glob", "file")
    hit = cv.glob_matches(pairs.select("project", "file"), pairs.select("project", "glob").distinct())
    missing = pairs.join(hit, ["project", "glob", "file"], "left_anti")
    assert missing.count() == 0


def test_plan(spark):
    m = meta(
        spark,
        ("exact", "c1", ["src/a.ts"], []),
        ("glob", "c1", [], ["src/*.ts"]),
        ("other", "c1", ["src/z.ts"], []),
        ("mtime", None, ["src/n.ts"], []),
        ("gone", "c1", ["src/missing.ts"], []),
    )
    f = files(spark, ("src/a.ts", OLD), ("src/z.ts", OLD), ("src/n.ts", NEW))
    got = plan(tr.plan_incremental(m, changes(spark, ("c1", "src/a.ts")), f))
    assert got == {
        "exact": ("stale", "source_file"),
        "glob": ("stale", "source_glob"),
        "other": ("fresh", None),
        "mtime": ("stale", "source_file_mtime"),
        "gone": ("stale", "orphaned_source"),
    }


def test_plan_without_changes_and_inheritance(spark):
    f = files(spark, ("src/a.ts", OLD))
    lone = meta(spark, ("x", None, [], []))
    assert plan(tr.plan_incremental(lone, changes(spark), f)) == {"x": ("unknown", None)}
    m = meta(spark, ("top", "c1", ["src/gone.ts"], []), ("top/mid", None, [], []), ("top/mid/leaf", None, [], []), ("else", None, [], []))
    df = tr.plan_incremental(m, changes(spark), f)
    assert {r["path"]: r["inherited_from"] for r in df.collect()} == {
        "top": None, "top/mid": "top", "top/mid/leaf": "top/mid", "else": None,
    }
    child = meta(spark, ("top", "c1", ["src/z.ts"], []), ("top/kid", "c1", ["src/a.ts"], []))
    got = plan(tr.plan_incremental(child, changes(spark, ("c1", "src/a.ts")), files(spark, ("src/a.ts", OLD), ("src/z.ts", OLD))))
    assert got == {"top": ("fresh", None), "top/kid": ("stale", "source_file")}


def test_coverage(spark):
    m = meta(
        spark,
        ("auth", None, [], []),
        ("db", None, ["src/db/x.ts"], []),
        ("all", None, [], ["src/api/**"]),
        ("dead", None, ["nope.ts"], []),
    )
    f = files(spark, ("src/auth/login.ts", OLD), ("src/db/x.ts", OLD), ("src/api/h.ts", OLD), ("README", OLD))
    cover = cv.coverage_map(f, m)
    got = {r["path"]: (r["element"], r["method"]) for r in cover.collect()}
    assert got == {
        "src/auth/login.ts": ("auth", "heuristic"),
        "src/db/x.ts": ("db", "source_files"),
        "src/api/h.ts": ("all", "source_globs"),
        "README": (None, None),
    }
    assert cv.coverage_stats(cover, m).first()["coverage_pct"] == 75
    assert [r["path"] for r in cv.orphaned_elements(cover, m).collect()] == ["dead"]
    assert [(r["path"], r["file"]) for r in cv.orphaned_sources(m, f).collect()] == [("dead", "nope.ts")]


def defs(spark, *rows):
    return spark.createDataFrame([("p", *r) for r in rows], "project string, file string, name string, kind string, line int, end_line int")


def test_fingerprints(spark):
    prev = defs(spark, ("same", "f", "function", 1, 2), ("ch", "f", "function", 1, 2), ("ch", "g", "class", 3, 9), ("old", "h", "class", 1, 2))
    curr = defs(spark, ("same", "f", "function", 1, 2), ("ch", "f", "function", 1, 5), ("ch", "k", "class", 6, 9), ("new", "n", "class", 1, 2))
    got = {r["file"]: (r["added"], r["removed"], r["modified"], r["unchanged"]) for r in tr.fingerprint_deltas(prev, curr).collect()}
    assert got == {"ch": (1, 1, 1, 0), "new": (1, 0, 0, 0), "old": (0, 1, 0, 0)}
