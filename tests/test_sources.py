from pyspark.sql import functions as F

from arborist.operators import extract as ex
from arborist.operators import search as se
from arborist.sources import corpus as co
from arborist.sources import sinks


def source(spark, **files):
    return spark.createDataFrame(
        [("p", k, v) for k, v in files.items()], "project string, path string, content string"
    )


def imports(spark, path, text):
    df = ex.extract_imports(spark.createDataFrame([("p", path, text)], "project string, path string, content string"))
    return sorted((r["line"], r["source"], r["specifiers"], r["default_name"], r["namespace"]) for r in df.collect())


def exports(spark, path, text, **kw):
    df = ex.extract_exports(spark.createDataFrame([("p", path, text)], "project string, path string, content string"), **kw)
    return sorted((r["line"], r["name"], r["kind"]) for r in df.collect())


def test_imports_by_language(spark):
    js = "import d, { a as b,\n  c } from './x'\nimport * as ns from \"../y\"\nconst z = require('./z')\nimport './side'\n// import q from 'q'"
    assert imports(spark, "src/m.ts", js) == [
        (1, "./x", ["a", "c"], "d", None), (3, "../y", [], None, "ns"), (4, "./z", [], None, None), (5, "./side", [], None, None),
    ]
    py = "import os.path\nimport numpy as np, sys\nfrom a.b import (c,\n  d as e)\nfrom x import *"
    assert imports(spark, "m.py", py) == [
        (1, "os.path", ["os"], None, None), (2, "numpy", ["np"], None, None), (2, "sys", ["sys"], None, None),
        (3, "a.b", ["c", "d"], None, None), (5, "x", [], None, None),
    ]
    go = 'import "fmt"\nimport (\n  "net/http"\n  al "a/b"\n)'
    assert [(x[0], x[1], x[2]) for x in imports(spark, "m.go", go)] == [(1, "fmt", ["fmt"]), (2, "a/b", ["al"]), (2, "net/http", ["http"])]
    assert [x[1:3] for x in imports(spark, "m.rs", "use std::io;\nuse a::b::*;\nextern crate serde;")] == [
        ("std::io", ["io"]), ("a::b", []), ("serde", ["serde"]),
    ]
    assert [x[1:3] for x in imports(spark, "M.java", "import a.b.C;\nimport static x.y.*;")] == [("a.b.C", ["C"]), ("x.y", [])]
    assert [x[1:3] for x in imports(spark, "m.kt", "import a.b.C\nimport x.*")] == [("a.b.C", ["C"]), ("x", [])]
    assert [x[1:3] for x in imports(spark, "m.scala", "import a.b.C\nimport x.{D, E}\nimport y._")] == [
        ("a.b.C", ["C"]), ("D", ["D"]), ("E", ["E"]), ("y", []),
    ]


def test_exports_by_language(spark):
    ts = "export function f() {}\nexport default class K {}\nexport { a, b as c }\nexport const v = 1\nexport type T = string"
    assert exports(spark, "m.ts", ts) == [(1, "f", "function"), (2, "K", "class"), (3, "a", "variable"), (3, "b", "variable"), (5, "T", "type")]
    assert (4, "v", "variable") in exports(spark, "m.ts", ts, lexical=True)
    assert exports(spark, "m.js", "module.exports = x\nexports.foo = 1") == [(1, "exports", "variable"), (2, "foo", "variable")]
    py = "__all__ = ['f', 'K']\ndef f(): pass\ndef g(): pass\nclass K: pass\ndef _h(): pass"
    assert exports(spark, "m.py", py) == [(2, "f", "function"), (4, "K", "class")]
    assert exports(spark, "m.go", "func Run() {}\nfunc run() {}\ntype T struct {}\ntype I interface {}") == [(1, "Run", "function"), (3, "T", "class"), (4, "I", "interface")]
    assert exports(spark, "m.rs", "pub fn a() {}\nfn b() {}\npub struct S;\npub(crate) enum E {}") == [(1, "a", "function"), (3, "S", "class"), (4, "E", "enum")]
    assert exports(spark, "M.java", "public class A {}\nclass B {}\npublic interface I {}") == [(1, "A", "class"), (3, "I", "interface")]
    assert exports(spark, "m.kt", "fun a() {}\nprivate fun b() {}\ndata class C(val x: Int)") == [(1, "a", "function"), (3, "C", "class")]
    assert exports(spark, "m.scala", "object O\ntrait T\nprivate class P") == [(1, "O", "class"), (2, "T", "interface")]


def test_routes(spark):
    df = ex.extract_routes(
        source(
            spark,
            **{
                "a.js": "app.get('/x', ctl.show)\nx.y()",
                "app/urls.py": "urlpatterns = [path('users/', views.users)]",
                "f.py": "@app.get('/u')\n@auth\ndef get_u():\n    pass",
                "A.java": '  @GetMapping("/j")\n  public String j() {}',
                "c.ts": "  @Post('/n')\n  create() {}",
                "m.go": 'r.GET("/g", h)',
            },
        )
    )
    got = sorted((r["framework"], r["method"], r["path"], r["handler"], r["line"]) for r in df.collect())
    assert got == [
        ("django", "ANY", "/users/", "views.users", 1), ("express", "GET", "/x", "show", 1), ("fastapi", "GET", "/u", "get_u", 1),
        ("flask", "GET", "/u", "get_u", 1), ("gin", "GET", "/g", "handler", 1), ("nestjs", "POST", "/n", "create", 2 - 1),
        ("spring", "GET", "/j", "j", 1),
    ]


def routes(spark, name, text):
    found = ex.extract_routes(source(spark, **{name: text})).collect()
    return sorted((r["line"], r["framework"], r["method"], r["path"], r["handler"]) for r in found)


def test_decorators_take_their_own_handler(spark):
    java = '@RequestMapping("/api")\npublic class C {\n  @GetMapping("/x")\n  // note\n  public String x() { return y(1); }\n  @PostMapping("/y")\n  // a comment\n  void y(int a) {}\n  @DeleteMapping("/z") void z() {}\n}'
    assert routes(spark, "C.java", java) == [(3, "spring", "GET", "/x", "x"), (6, "spring", "POST", "/y", "y"), (9, "spring", "DELETE", "/z", "z")]
    py = '@router.get("/a")\n# why\ndef a():\n    pass\n\n@router.post("/b")\nasync def b():\n    pass\n@bp.route("/c")\nclass View:\n    pass\n'
    assert routes(spark, "m.py", py) == [(1, "fastapi", "GET", "/a", "a"), (6, "fastapi", "POST", "/b", "b"), (9, "flask", "ANY", "/c", "View")]
    assert routes(spark, "a.js", "app.get('/x', c.x); app.post('/y', y)\napp.all('/z', (q) => q)") == [
        (1, "express", "GET", "/x", "x"), (1, "express", "POST", "/y", "y"), (2, "express", "ALL", "/z", "anonymous")
    ]


def test_routes_in_a_long_file(spark):
    text = "".join(f"@app.get('/r{k}')\n# c\ndef h{k}():\n    pass\n" for k in range(4000))
    found = routes(spark, "m.py", text)
    assert len(found) == 8000 and all(r[3] == f"/r{r[0] // 4}" and r[4] == f"h{r[0] // 4}" for r in found)


def test_scan_ignore_and_elements(spark, tmp_path):
    tree = {
        "p/src/a.ts": "x", "p/src/b.min.js": "x", "p/dist/c.ts": "x", "p/.hid/d.ts": "x", "p/README.md": "x",
        "p/docs/description.md": "hello", "p/docs/diagram.puml": "@startuml", "p/docs/diagram.mmd": "graph LR", "p/docs/note.md": "  ",
    }
    for name, text in tree.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    code = co.scan_corpus(spark, str(tmp_path))
    kept = co.apply_ignore(code)
    assert sorted(r["path"] for r in kept.select("path").collect()) == ["src/a.ts"]
    docs = co.load_elements(co.scan_corpus(spark, str(tmp_path), None))
    got = sorted((r["path"], r["field"], r["text"], r["format"]) for r in docs.collect() if r["path"] == "docs")
    assert got == [("docs", "description", "hello", None), ("docs", "diagram", "graph LR", "flowchart")]
    rules = spark.createDataFrame([("p", "*.ts\n!src/a.ts")], "project string, content string")
    assert sorted(r["path"] for r in co.apply_ignore(code, rules, builtin_dirs=False).collect()) == ["src/a.ts"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", "a", 1), ("q", "b", 2)], "project string, path string, n int")
    out = str(tmp_path / "mirror")
    sinks.snapshot_elements(df, out)
    sinks.snapshot_elements(df.where("project = 'p'").withColumn("path", F.lit("z")), out)
    assert sorted((r["project"], r["path"]) for r in spark.read.parquet(out).collect()) == [("p", "z"), ("q", "b")]
    sinks.append_run(df, str(tmp_path / "runs"))
    sinks.append_run(df, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 4
    sinks.save_fingerprints(df, str(tmp_path / "fp"))
    assert sinks.load_fingerprints(spark, str(tmp_path / "fp")).count() == 2
    many = spark.range(500).select(F.lit("p").alias("project"), F.lpad(F.col("id").cast("string"), 4, "0").alias("f"))
    numbered = sinks.number_rows(many, "project", ["f"], "n")
    assert numbered.where(F.col("n") != F.col("f").cast("int")).count() == 0


def test_fingerprints_of_many_projects_are_few_files(spark, tmp_path):
    path = tmp_path / "fp"
    prints = spark.range(2000).select(F.concat(F.lit("s"), F.col("id") % 300).alias("project"), F.concat(F.lit("f"), "id").alias("file"), F.lit("a").alias("hash"))
    sinks.save_fingerprints(prints, str(path))
    later = prints.where("project < 's2'").limit(50).withColumn("hash", F.lit("b"))
    later = spark.createDataFrame(later.collect(), later.schema)
    sinks.save_fingerprints(later, str(path))
    assert len(list(path.rglob("*.parquet"))) < 50
    got = sinks.load_fingerprints(spark, str(path)).select("project", "file", "hash")
    want = prints.join(later.select("project").distinct(), "project", "left_anti").unionByName(later)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("project", "file", "hash").collect()))


def test_search(spark):
    rows = [
        ("p", "persp1", "description", "payments and auth overview"), ("p", "persp1/auth", "description", "login flow"),
        ("p", "persp1/payments", "note", "charges cards"),
    ]
    f = spark.createDataFrame(rows, "project string, path string, field string, text string")
    el = f.select("project", "path").distinct()
    top = se.weighted_search(f, "payments").orderBy(F.desc("score")).first()
    assert (top["path"], top["score"]) == ("persp1", (16 + 24) * 4.0)
    fuzzy = se.weighted_search(f, "paymnts").first()
    assert fuzzy["score"] == (7 - 1) * 1.5 * 4
    names = {r["path"]: r["score"] for r in se.fuzzy_search(el, f, ["auth"]).collect()}
    assert names == {"persp1/auth": 100, "persp1": 40}
    shown = se.weighted_search(f, "auth", with_snippet=True).first()["snippet"]
    assert "<mark>auth</mark>" in shown


def test_load_meta(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"project": "p", "path": "a", "tags": ["x"], "scan_generation": {"mode": "full", "git_commit": "c1"}}\n')
    row = co.load_meta(spark, str(tmp_path / "m.json")).first()
    assert (row["path"], row["tags"], row["scan_generation"]["git_commit"], row["source_files"]) == ("a", ["x"], "c1", None)
    assert "steps" in co.load_meta(spark, str(tmp_path / "m.json"), co.FLOW_SCHEMA).columns


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    import pytest

    from arborist.session import shared_root

    def session(master, **conf):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda k, *d: conf.get(k, *d)))

    local = {"spark.sql.warehouse.dir": "file:/tmp/w"}
    assert shared_root(session("local[8]", **local)).startswith("file:/tmp/w")
    with pytest.raises(ValueError):
        shared_root(session("spark://host:7077", **local))
    assert shared_root(session("yarn", **local, **{"spark.checkpoint.dir": "hdfs:/shared/"})) == "hdfs:/shared"
    assert shared_root(session("yarn", **{"spark.sql.warehouse.dir": "hdfs:/w"})).startswith("hdfs:/w")
