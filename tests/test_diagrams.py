from arborist.operators import diagrams as dg
from arborist.operators import docs as dc
from arborist.operators import quality as ql


def fields(spark, *texts, field="diagram"):
    return spark.createDataFrame(
        [("p", path, field, text) for path, text in texts], "project string, path string, field string, text string"
    )


def elements(spark, *paths):
    return spark.createDataFrame([("p", p) for p in paths], "project string, path string")


def rules(df):
    return sorted(((r["line"], r["rule"]) for r in df.collect()), key=str)


def test_parse(spark):
    f = fields(spark, ("x", 'graph LR\n  A["One"] --> B\n  A -->|calls| C{Two}\n  D(Three)\n  %% no\n  classDef entry fill:#fff'))
    got = sorted((r["src"], r["arrow"], r["dst"]) for r in dg.diagram_edges(f).collect())
    assert got == [("A", "-->", "B"), ("A", "-->", "|calls|")]
    assert sorted(r["node"] for r in dg.diagram_nodes(f).collect()) == ["A", "B", "D", "|calls|"]


def test_flowchart(spark):
    f = fields(spark, ("x", 'graph TD\nA["see @pay"] -->|uses| B(("Two"))\n@ref\nA -- "note" --> C\nclass A,B hot'))
    nodes = {r["node"]: (r["label"], r["shape"], r["is_ref"], r["ref_target"], r["class"]) for r in dg.flowchart_nodes(f).collect()}
    assert nodes["A"] == ("see @pay", "rect", False, None, "hot")
    assert nodes["B"] == ('"Two"', "stadium", False, None, "hot")
    assert nodes["ref"] == ("ref", "rect", True, None, None)
    assert sorted((r["src"], r["dst"], r["label"]) for r in dg.flowchart_edges(f).collect()) == [("A", "B", "uses"), ("A", "C", "note")]
    assert dg.flowchart_directions(f).first()["direction"] == "TB"


def test_lint_lines(spark):
    good = "graph LR\nA -->|x| B\nB -->|y| C"
    assert not [r for _, r in rules(dg.lint_diagrams(fields(spark, ("x", good)))) if r != "node-count"]
    bad = 'A --> B\nC[open\nD["(quoted"] -->|ok| E\nend[Stop]\nF["a @ b"]\nG[x <b> y]\nclassDef entry fill:#000000\nclassDef odd fill:#fff'
    got = rules(dg.lint_diagrams(fields(spark, ("x", bad))))
    assert (1, "graph-declaration") in got and (1, "edge-label") in got
    assert (2, "balanced-brackets") in got and (3, "balanced-brackets") not in got
    assert (4, "reserved-word") in got
    assert (5, "special-char-label") in got and (6, "special-char-label") in got
    assert (7, "classdef-color") in got and (8, "classdef-name") in got


def test_lint_refs(spark):
    f = fields(spark, ("a", 'graph LR\nx["@a"] -->|1| y["@b"]\ny -->|2| z["@gone"]'))
    got = [r for _, r in rules(dg.lint_diagrams(f, elements(spark, "a", "b"))) if "ref" in r]
    assert sorted(got) == ["perspective-cross-ref", "potential-circular-ref", "potential-circular-ref", "ref-exists", "ref-self"]


def test_sequence_lint(spark):
    ok = "@startuml\nparticipant A\nparticipant B\nA -> B\nloop x\nend\n@enduml"
    assert dg.lint_sequence_diagrams(fields(spark, ("x", ok))).count() == 0
    bad = "participant A\nloop x\nend\nend\nalt y"
    got = sorted(r["rule"] for r in dg.lint_sequence_diagrams(fields(spark, ("x", bad))).collect())
    assert got == ["few-participants", "missing-enduml", "missing-startuml", "no-messages", "unbalanced-blocks"]


def test_repair(spark):
    text = 'graph LR\n  end[Stop] --> A["end of @x <y>"]\n  A --> end %% end\n  classDef entry fill:#000000,stroke:#89b4fa'
    f = fields(spark, ("x", text))
    fixed = dg.repair_diagrams(f).first()["fixed"]
    assert fixed == (
        'graph LR\n  end-node[Stop] --> A["end of →x &lt;y&gt;"]\n  A --> end-node %% end\n'
        "  classDef entry  fill:#89b4fa,stroke:#89b4fa"
    )
    report = {(r["line"], r["rule"], r["message"][:16]): r["fixed"] for r in dg.repair_report(dg.lint_diagrams(f)).collect()}
    assert report[(2, "reserved-word", 'Node ID "end" is')] and report[(2, "special-char-label", "Label contains @")]
    assert not report[(2, "special-char-label", "Label contains <")]


def test_diff(spark):
    d = dg.diagram_diff(fields(spark, ("x", "A --> B")), fields(spark, ("x", "A --> C")))
    assert sorted((r["what"], r["item"], r["change"]) for r in d.collect()) == [
        ("edge", "A --> B", "removed"), ("edge", "A --> C", "added"), ("node", "B", "removed"), ("node", "C", "added"),
    ]


def score(spark, f, paths, flows=()):
    el = elements(spark, *paths)
    fl = spark.createDataFrame([("p", x, "f") for x in flows], "project string, path string, name string")
    return ql.score_elements(el, f, fl, dg.extract_refs(f), dg.lint_diagrams(f, el))


def test_scores(spark):
    text = "graph LR\nA -->|x| B\nB -->|y| C"
    full = fields(spark, ("auth", text))
    for name in ("description", "constraint", "concern", "context", "todo", "note"):
        full = full.unionByName(fields(spark, ("auth", "A long enough text to count as a description of it all."), field=name))
    r = score(spark, full, ["auth"]).first()
    assert r["score"] >= 80 and r["fields_present"] == 7 and r["diagram_valid"]
    parts = sum(r[f"{p}_points"] for p in ql.PART_MAX)
    assert round(parts) == r["score"]
    bad = fields(spark, ("auth", "not a flowchart"))
    s = score(spark, bad, ["auth", "auth/a", "auth/b"])
    kinds = {i["type"] for i in ql.quality_issues(s, dg.undocumented_diagram_nodes(bad, elements(spark, "auth"))).collect()}
    assert {"missing-description", "invalid-diagram", "incomplete-children", "sparse-fields", "no-flows"} <= kinds
    assert sorted(x["type"] for x in s.collect()) == ["leaf", "leaf", "perspective"]


def test_signature_is_one_rule_whatever_the_order(spark):
    from arborist.functions.text import lane_digest

    el = elements(spark, *[f"e{i}" for i in range(50)])
    one = lane_digest(el, ["project"], "path").first()
    again = lane_digest(el.repartition(5), ["project"], "path").first()
    less = lane_digest(el.where("path <> 'e7'"), ["project"], "path").first()
    assert one["n_items"] == 50 and one["digest"] == again["digest"] != less["digest"]
    assert dc.signature(el).first()["signature"] == "sha256:" + one["digest"]


def test_split_tags(spark):
    raw = spark.createDataFrame([("p", "a", '["x", 3, {"k": "v, w"}, "y z"]'), ("p", "b", "[]")], "project string, path string, tags_json string")
    got = {r["path"]: (r["tags"], r["corrupted"]) for r in dc.split_tags(raw).collect()}
    assert got == {"a": (["x", "y z"], 2), "b": ([], 0)}


def test_tree_order(spark):
    f = fields(spark, ("a", "x"), field="description")
    tree = dc.element_tree(elements(spark, "a", "a-b", "a/z", "a/y"), f).orderBy("project", "sort_key")
    assert [(r["path"], r["is_last"]) for r in tree.collect()] == [("a", False), ("a/y", False), ("a/z", True), ("a-b", True)]


def test_flowchart_steps_run_once_and_keep_control_characters(spark):
    """A token's steps stand once each in the plan, not once for each use; a control character in a line cuts nothing."""
    f = spark.createDataFrame([("p", "x", "diagram", 'a["@ref\\nA"] -->|go| b((B))\nc\u0001d --> e\nlone{Q}')], "project string, path string, field string, text string")
    plan = dg.flowchart_edges(f)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(@?[\\w-]+)") <= 2
    assert [(r.src, r.dst, r.label) for r in dg.flowchart_edges(f).orderBy("line_no").collect()] == [("a", "b", "go")]
    assert [(r.node, r.shape, r.ref_target) for r in dg.flowchart_nodes(f).orderBy("node").collect()] == [("a", "rect", "ref"), ("b", "stadium", None), ("lone", "diamond", None)]
    assert [(r.src, r.dst) for r in dg.diagram_edges(f).where("src LIKE 'c%'").collect()] == [("c\u0001d", "e")]


def test_repair_time_follows_the_lines(spark):
    """The reserved ids of a diagram are found once, not for each of its lines."""
    import time

    text = "graph LR\nend[Stop] --> x\n" + "\n".join(f"n{i}[N {i}] --> end" for i in range(5000))
    f = spark.createDataFrame([("p", "x", "diagram", text)], "project string, path string, field string, text string")
    began = time.monotonic()
    fixed = dg.repair_diagrams(f).first().fixed.split("\n")
    assert time.monotonic() - began < 40
    assert fixed[1] == "end-node[Stop] --> x" and fixed[-1] == "n4999[N 4999] --> end-node" and len(fixed) == 5002
