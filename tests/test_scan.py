"""Statements behind comments, strings, templates and open brackets, in eight languages."""

import time

import pytest

from arborist.operators import extract as ex
from arborist.operators import scan

SCHEMA = "project string, path string, content string"

HIDDEN = {
    "a.ts": "/* import x from './no';\nimport y from './no2';\n*/\nconst s = `\nimport z from './no3'\n${f(`a`)}`;\nimport z from './real'; import w from './second';\nconst q = \"require('./no4')\", r = /require('.\\/no5')/, t = 'it\\'s'; // import v from './no6'\nconst u = require('./third') /* x */ ; let c = a / b / c;",
    "b.js": "import {\n  a, // one\n  b /* two */\n}\n  from './real'\nexport { x }\nimport\n  d\n  from \"./second\"\nlet s = 'http://x.y/*'; const t = require(\"./third\")",
    "c.py": '"""\nimport no\n"""\nx = \'\'\'\nfrom no import b\n\'\'\'\nimport real  # import no\ns = "import no2"; import second\nfrom third import (a, # c\n  b)\nfrom fourth import \\\n  z\n',
    "d.go": "package x\n/*\nimport \"no\"\n*/\nvar s = `\nimport \"no2\"\n`\nimport (\n  \"real\" // import \"no3\"\n  z `second`\n)\n",
    "e.rs": "/* use no::a; */\nlet s = r#\"\nuse no::b;\n\"#; let t = \"\nuse no::c;\n\";\nuse real::x; use second::y;\nuse\n  third::z;\nfn f<'a>(x: &'a str) -> char { ';' }\n",
    "F.java": 'String s = """\n  import no.A;\n  """;\n/* import no.B; */ import real.C; import second.D;\n// import no.E;\nchar c = \'"\'; String t = "/*";\nimport third.F;',
    "g.kt": 'val s = """\nimport no.A\n"""\n/*\nimport no.B\n*/\nimport real.C; import second.D\n',
    "h.scala": 'val s = """\nimport no.A\n"""\nimport real.{\n  C,\n  D\n}\n/* import no.B */\nimport second.E\n',
}
FOUND = {
    "a.ts": [(7, "./real"), (7, "./second"), (9, "./third")],
    "b.js": [(1, "./real"), (7, "./second"), (10, "./third")],
    "c.py": [(7, "real"), (8, "second"), (9, "third"), (11, "fourth")],
    "d.go": [(8, "real"), (8, "second")],
    "e.rs": [(7, "real::x"), (7, "second::y"), (8, "third::z")],
    "F.java": [(4, "real.C"), (4, "second.D"), (7, "third.F")],
    "g.kt": [(7, "real.C"), (7, "second.D")],
    "h.scala": [(4, "C"), (4, "D"), (9, "second.E")],
}


def test_hidden_imports_of_all_languages(spark):
    rows = ex.extract_imports(spark.createDataFrame([("p", k, v) for k, v in HIDDEN.items()], SCHEMA)).collect()
    found = {}
    for r in rows:
        found.setdefault(r["file"], []).append((r["line"], r["source"]))
    assert {k: sorted(v) for k, v in found.items()} == FOUND


def test_hidden_exports(spark):
    texts = {
        "a.ts": "/*\nexport function no() {}\n*/ export function f() {}\nconst t = `\nexport class No {}\n`; export class K {} export\n{ x,\n y }",
        "b.py": '"""\ndef no(): pass\n"""\n__all__ = [\n  "f", # "g"\n  \'h\',\n]\ndef f(): pass\ndef g(): pass\n# def h(): pass\nh = 1',
        "c.go": "/*\nfunc No() {}\n*/\nfunc Yes() {}\nvar s = `\nfunc No2() {}\n`",
        "D.java": "/**\npublic class No {}\n*/\npublic class Yes { String s = \"public class No2\"; }",
    }
    rows = ex.extract_exports(spark.createDataFrame([("p", k, v) for k, v in texts.items()], SCHEMA)).collect()
    assert sorted((r["file"], r["line"], r["name"]) for r in rows) == [
        ("D.java", 4, "Yes"), ("a.ts", 3, "f"), ("a.ts", 6, "K"), ("b.py", 8, "f"), ("b.py", 11, "h"), ("c.go", 4, "Yes"),
    ]


def test_broken_and_odd_texts(spark):
    texts = ["", None, "/* never closed\nimport a from './no'", "'open\nimport a from './yes'", "`open ${ `\nimport a from './yes'", "import a from './yes'\r\nimport b from './yes2'\r\n", "x = /[/'\"]/.test(y)\nimport a from './yes'", "\\", "{}}}((("]
    df = spark.createDataFrame([("p", f"{i}.ts", t) for i, t in enumerate(texts)] + [("p", "x.md", "import a from './no'")], SCHEMA)
    found = sorted((r["file"], r["line"], r["source"]) for r in ex.extract_imports(df).collect())
    assert found == [("3.ts", 2, "./yes"), ("4.ts", 2, "./yes"), ("5.ts", 1, "./yes"), ("5.ts", 2, "./yes2"), ("6.ts", 2, "./yes")]


def test_statements_keep_all_code(spark):
    code = "let a = 1; let b = 'x;y'\n\nfoo(a,\n  b)\nimport {\n c } from 'd'; bar()"
    rows = scan.statements(spark.createDataFrame([("p", "a.ts", code)], SCHEMA)).collect()
    assert [(r["line"], r["stmt"].strip()) for r in rows] == [
        (1, "let a = 1;"), (1, "let b = 'x;y'"), (3, "foo(a,"), (4, "b)"), (5, "import { c } from 'd'"), (6, ";"), (6, "bar()"),
    ]


def test_a_language_added_by_the_caller(spark):
    lexis = {"lisp": scan.Lexis(comments=r";[^\n]*+", blocks="", strings='"[^"]*+"', joined="")}
    df = spark.createDataFrame([("p", "a.l", '(a) ; b\n"x" (c)')], SCHEMA)
    from pyspark.sql import functions as F

    assert [r["stmt"] for r in scan.statements(df, F.lit("lisp"), lexis).collect()][-1] == '"x" (c)'


@pytest.mark.parametrize("unit", ["import {{\n  a{i},\n  b\n}} from './m{i}'\n", "import a{i}\n", "export {{ a{i}\n", "`${{ {i}\n", "x = '{i}\\''; /* {i} * */\n", "foo(\"{i}\"\n"])
def test_time_is_linear_in_the_text(spark, unit):
    def seconds(n):
        df = spark.createDataFrame([("p", "a.ts", "".join(unit.format(i=i) for i in range(n)))], SCHEMA)
        best = float("inf")
        for _ in range(3):
            start = time.perf_counter()
            ex.extract_imports(df).count()
            best = min(best, time.perf_counter() - start)
        return best

    seconds(500)
    assert seconds(16_000) < 2.2 * seconds(8_000) + 0.3
