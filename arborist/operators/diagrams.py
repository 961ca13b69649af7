"""Diagram texts: parsing, linting, repairing, comparing.

A diagram is one `fields` row with field = 'diagram'.  Parsing and linting
explode a text into lines and treat every line with native expressions;
repairing maps over the lines inside the row and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.functions.common import count_rows
from arborist.functions.paths import base_of, stem_of, trimmed
from arborist.functions.rules import (
    BROAD_EDGE,
    CLASSDEF_PALETTE,
    DIRECTIVE_LINE,
    FLOW_CLASS,
    FLOW_DIRECTION,
    FLOW_EDGE,
    FLOW_LABEL_EDGE,
    FLOW_SKIP,
    GRAPH_DECLARATION,
    HUB_PERSPECTIVES,
    NODE_LINE,
    RESERVED_WORDS,
    SKIP_LINE,
    STRICT_EDGE,
)

_SEP = "\u0001"


def _cut(c: Column, pattern: str, *groups: int) -> Column:
    """Two or more capture groups of an anchored pattern, found in one run: an array, of the text alone when there is no match."""
    joined = F.regexp_replace(c, pattern, _SEP.join(f"${g}" for g in groups))
    apart = F.when(c.rlike(pattern), F.array(*[F.regexp_extract(c, pattern, g) for g in groups])).otherwise(F.array(c))
    return F.when(c.contains(_SEP), apart).otherwise(F.split(joined, _SEP))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with further columns that are computed once a row: the planner copies an expression into each of its uses, but not out of a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def diagram_lines(fields: DataFrame) -> DataFrame:
    """(project, path, line_no, line): trimmed non-blank, non-comment lines of each diagram."""
    lines = fields.where("field = 'diagram'").select(
        "project", "path", F.posexplode(F.transform(F.split("text", "\n"), trimmed)).alias("pos", "line")
    )
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("%%")).select(
        "project", "path", (F.col("pos") + 1).alias("line_no"), "line"
    )


# ---- parsing --------------------------------------------------------------


def _parsed(fields: DataFrame) -> DataFrame:
    """(project, path, src, arrow, dst, node): an edge or a standalone node per row.

    Lines are read inside the row and each pattern runs once per line.
    """
    bare = lambda c: F.translate(c, "\"'", "")
    lines = F.filter(
        F.transform(F.split("text", "\n"), trimmed),
        lambda x: (x != "") & ~x.startswith("%%") & ~x.rlike(SKIP_LINE),
    )
    strict = F.transform(lines, lambda x: F.struct(x.alias("line"), _cut(x, STRICT_EDGE, 1, 2, 3).alias("cut")))
    either = F.transform(
        strict, lambda x: F.struct(x["line"].alias("line"), F.when(F.size(x["cut"]) > 1, x["cut"]).otherwise(_cut(x["line"], BROAD_EDGE, 1, 2, 3)).alias("cut"))
    )
    rows = fields.where("field = 'diagram'").select("project", "path", F.inline(either))
    edge = F.size("cut") > 1
    single = F.when(F.col("line").rlike(NODE_LINE), F.regexp_replace("line", NODE_LINE, "$1"))
    return rows.select(
        "project",
        "path",
        F.when(edge, bare(F.get("cut", F.lit(0)))).alias("src"),
        F.when(edge, F.get("cut", F.lit(1))).alias("arrow"),
        F.when(edge, bare(F.get("cut", F.lit(2)))).alias("dst"),
        F.when(~edge, bare(single)).alias("node"),
    )


def diagram_edges(fields: DataFrame) -> DataFrame:
    """Distinct (project, path, src, arrow, dst)."""
    return _parsed(fields).where("arrow IS NOT NULL").select("project", "path", "src", "arrow", "dst").distinct()


def diagram_nodes(fields: DataFrame) -> DataFrame:
    """Distinct (project, path, node): edge ends and standalone nodes."""
    return (
        _parsed(fields)
        .select(
            "project",
            "path",
            F.explode(F.when(F.col("arrow").isNotNull(), F.array("src", "dst")).otherwise(F.array("node"))).alias("node"),
        )
        .where("node IS NOT NULL")
        .distinct()
    )


def _tokens(lines: DataFrame, *names: str) -> DataFrame:
    """For each named text, a struct(id, label, shape, is_ref, ref_target) in its place; null when it is no flowchart token.

    Every step is a column of its own, so it runs once for a token.
    """

    def step(df: DataFrame, name: str, make) -> DataFrame:
        return _once(df, **{f"{n}_{name}": make(lambda k, n=n: F.col(f"{n}_{k}")) for n in names})

    def shape(of) -> Column:
        body = of("body")
        square, round_ = body.startswith("["), body.startswith("(")
        return (
            F.when(body == "", "bare")
            .when(square & body.rlike(r'^\["[^"]+"\]$'), "quoted")
            .when(square & body.rlike(r"^\[[^\]]+\]$"), "rect")
            .when(round_ & body.rlike(r"^\(\([^)]+\)\)$"), "stadium")
            .when(round_ & body.rlike(r"^\([^)]+\)$"), "round")
            .when(body.startswith("{") & body.rlike(r"^\{[^}]+\}$"), "diamond")
        )

    def text(of) -> Column:
        wide = of("shape").isin("quoted", "stadium")
        inner = F.when(wide, F.regexp_replace(of("body"), r"(?s)^..|..$", "")).otherwise(F.regexp_replace(of("body"), r"(?s)^.|.$", ""))
        return F.when(of("shape") != "bare", F.regexp_replace(F.regexp_replace(inner, r"(?i)<br\s*/?>", "\n"), r"\\n", "\n"))

    def token(of) -> Column:
        node = F.regexp_replace(of("raw"), "^@", "")
        label_ref = F.nullif(F.regexp_extract(of("text"), r"^@([\w-]+)", 1), F.lit(""))
        by_id = of("raw").startswith("@")
        return F.when(
            (of("raw") != "") & of("shape").isNotNull(),
            F.struct(
                node.alias("id"),
                F.coalesce(of("text"), node).alias("label"),
                F.when(of("shape").isin("quoted", "bare"), "rect").otherwise(of("shape")).alias("shape"),
                (by_id | label_ref.isNotNull()).alias("is_ref"),
                F.coalesce(label_ref, F.when(by_id & (of("shape") != "bare"), node)).alias("ref_target"),
            ),
        )

    kept = [c for c in lines.columns if c not in names]
    out = _once(lines, **{f"{n}_t": trimmed(F.col(n)) for n in names})
    out = step(out, "raw", lambda of: F.regexp_extract(of("t"), r"^(@?[\w-]+)", 1))
    out = step(out, "body", lambda of: F.substring(of("t"), F.length(of("raw")) + 1, F.length(of("t"))))
    out = step(step(out, "shape", shape), "text", text)
    return step(out, "token", token).select(*kept, *[F.col(f"{n}_token").alias(n) for n in names])


def _flow_lines(fields: DataFrame) -> DataFrame:
    """(project, path, line_no, label, edge, s, d): tokens of every flowchart line; a line that is no edge has one, `s`."""

    def plain(line: Column) -> Column:
        return (line != "") & ~line.startswith("%%") & ~line.rlike(FLOW_DIRECTION) & ~line.rlike(FLOW_SKIP) & ~line.rlike(FLOW_CLASS)

    lines = F.transform(F.transform(F.split("text", "\n"), trimmed), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    rows = fields.where("field = 'diagram'").select("project", "path", F.inline(F.filter(lines, lambda x: plain(x["line"]))))
    line = F.col("line")
    # a label stands in quotes
    rows = _once(rows, le=F.when(line.contains('"'), _cut(line, FLOW_LABEL_EDGE, 1, 2, 3)))
    labelled = F.coalesce(F.size("le") > 1, F.lit(False))
    rows = _once(rows, cut=F.when(labelled, F.col("le")).otherwise(_cut(line, FLOW_EDGE, 1, 2, 3)))
    edge, middle = F.size("cut") > 1, F.get("cut", F.lit(1))
    label = F.when(labelled, middle).when(edge & middle.contains("|"), F.regexp_extract(middle, r"\|([^|]+)\|", 1)).when(edge, "")
    ends = rows.select(
        "project",
        "path",
        "line_no",
        F.regexp_replace(label, r"(?i)<br\s*/?>", " ").alias("label"),
        edge.alias("edge"),
        F.get("cut", F.lit(0)).alias("s"),
        F.when(edge, F.get("cut", F.lit(2))).alias("d"),
    )
    return _tokens(ends, "s", "d")


def flowchart_edges(fields: DataFrame) -> DataFrame:
    """Edges of each flowchart with their labels, in line order."""
    both = F.col("s").isNotNull() & F.col("d").isNotNull()
    row = F.struct(F.col("s.id").alias("src"), F.col("d.id").alias("dst"), "label")
    return _flow_lines(fields).select("project", "path", "line_no", F.inline(F.when(both, F.array(row))))


def flowchart_nodes(fields: DataFrame) -> DataFrame:
    """Nodes of each flowchart: label, shape, reference target, class.  The first mention wins."""
    lines = _flow_lines(fields)
    both = F.col("s").isNotNull() & F.col("d").isNotNull()
    mentions = F.when(
        both,
        F.array(
            F.struct(F.lit(0).alias("pos"), F.col("s").alias("t")), F.struct(F.lit(1).alias("pos"), F.col("d").alias("t"))
        ),
    ).when(~F.col("edge") & F.col("s").isNotNull(), F.array(F.struct(F.lit(0).alias("pos"), F.col("s").alias("t"))))
    first = (
        lines.select("project", "path", "line_no", F.inline(mentions))
        .groupBy("project", "path", F.col("t.id").alias("node"))
        .agg(F.min_by("t", F.struct("line_no", "pos")).alias("t"))
    )
    parts = _cut(F.col("line"), FLOW_CLASS, 1, 2)
    classes = (
        diagram_lines(fields)
        .where(F.col("line").rlike(FLOW_CLASS) & ~F.col("line").rlike(FLOW_SKIP))
        .select(
            "project",
            "path",
            "line_no",
            F.explode(F.split(F.get(parts, F.lit(0)), ",")).alias("node"),
            F.get(parts, F.lit(1)).alias("class"),
        )
        .groupBy("project", "path", trimmed(F.col("node")).alias("node"))
        .agg(F.max_by("class", "line_no").alias("class"))
    )
    return first.join(classes, ["project", "path", "node"], "left").select(
        "project", "path", "node", "t.label", "t.shape", "t.is_ref", "t.ref_target", "class"
    )


def flowchart_directions(fields: DataFrame) -> DataFrame:
    """Layout direction of each flowchart (the last declaration counts; LR by default)."""
    found = F.upper(F.regexp_replace("line", FLOW_DIRECTION, "$1"))
    last = (
        diagram_lines(fields)
        .groupBy("project", "path")
        .agg(F.max_by(found, F.when(F.col("line").rlike(FLOW_DIRECTION), F.col("line_no"))).alias("d"))
    )
    return last.select(
        "project", "path", F.when(F.col("d").isin("TD", "TB"), "TB").otherwise(F.coalesce("d", F.lit("LR"))).alias("direction")
    )


def explode_flows(flows: DataFrame) -> DataFrame:
    """Flow steps in order; an edge step `a->b` gives its two ends."""
    steps = flows.select("project", "path", "name", F.posexplode("steps").alias("step", "what"))
    ends = F.split("what", "->")
    edge = F.col("what").contains("->")
    return steps.select(
        "project",
        "path",
        "name",
        "step",
        F.when(~edge, F.col("what")).alias("node"),
        F.when(edge, F.get(ends, F.lit(0))).alias("src"),
        F.when(edge, F.get(ends, F.lit(1))).alias("dst"),
    )


# ---- line-level rules ------------------------------------------------------


def outside_quotes(line: Column) -> Column:
    return F.filter(F.split(line, '"', -1), lambda p, i: i % 2 == 0)


def inside_quotes(line: Column) -> Column:
    return F.filter(F.split(line, '"', -1), lambda p, i: i % 2 == 1)


def brackets_balanced(line: Column) -> Column:
    """Counts of the three bracket pairs agree outside quotes."""
    return _balanced(F.array_join(outside_quotes(line), ""))


def _balanced(text: Column) -> Column:
    def n(ch: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))

    return (n("[") == n("]")) & (n("(") == n(")")) & (n("{") == n("}"))


def _declares(line: Column) -> Column:
    return (line != "") & ~line.startswith("%%") & ~line.startswith("classDef ")


def declared_node_ids(line: Column) -> Column:
    """Ids declared on a trimmed line, ignoring quoted text."""
    ids = F.flatten(
        F.transform(outside_quotes(line), lambda p: F.regexp_extract_all(p, F.lit(r"\b(\w+)\s*[\[(\{]"), F.lit(1)))
    )
    return F.when(_declares(line), ids).otherwise(F.array().cast("array<string>"))


def labels(line: Column) -> Column:
    """Label texts of a trimmed line: quoted text, then bracketed text outside quotes."""
    bracketed = F.flatten(
        F.transform(
            outside_quotes(line), lambda p: F.regexp_extract_all(p, F.lit(r"[\[(\{]([^\]\})]*)[\]\})]"), F.lit(1))
        )
    )
    return F.when(_declares(line), F.concat(inside_quotes(line), bracketed)).otherwise(F.array().cast("array<string>"))


_PALETTE = {f"{name}.{attr}": color for name, attrs in CLASSDEF_PALETTE.items() for attr, color in attrs.items()}


def _palette() -> Column:
    return F.create_map(*[F.lit(x) for kv in _PALETTE.items() for x in kv])


def _issue(level: str, rule: str, message: Column, order: int) -> Column:
    return F.struct(
        F.lit(level).alias("level"), F.lit(rule).alias("rule"), message.alias("message"), F.lit(order).alias("ord")
    )


def _line_issues(parts: Column) -> Column:
    """Issues of a line given as struct(x: the line, bare: its text outside quotes, ids, marks: its labels).

    The last three are null where a line has no bracket, quote or class definition.
    """
    line = parts["x"]
    none = F.array().cast("array<struct<level:string,rule:string,message:string,ord:int>>")

    def one(cond: Column, level: str, rule: str, text: str, order: int) -> Column:
        return F.when(cond, F.array(_issue(level, rule, F.concat(F.lit(text), line), order))).otherwise(none)

    reserved = F.transform(
        F.filter(parts["ids"], lambda i: F.lower(i).isin(*RESERVED_WORDS)),
        lambda i: _issue("error", "reserved-word", F.concat(F.lit('Node ID "'), i, F.lit('" is a reserved keyword')), 2),
    )
    marks = parts["marks"]
    name = F.regexp_extract(line, r"(?i)^classDef\s+(\S+)\s+(.+)$", 1)
    attrs = F.regexp_extract(line, r"(?i)^classDef\s+(\S+)\s+(.+)$", 2)
    wrong = F.filter(
        F.regexp_extract_all(attrs, F.lit(r"(\w+\s*:\s*#[0-9a-fA-F]{3,8})"), F.lit(1)),
        lambda a: F.coalesce(
            F.try_element_at(_palette(), F.concat(name, F.lit("."), F.regexp_extract(a, r"^(\w+)", 1)))
            != F.lower(F.regexp_extract(a, r"(#.*)$", 1)),
            F.lit(False),
        ),
    )
    colors = F.transform(
        wrong,
        lambda a: _issue(
            "warning",
            "classdef-color",
            F.concat(
                F.lit('classDef "'), name, F.lit('" has '), F.regexp_replace(a, r"\s", ""), F.lit(", expected "),
                F.try_element_at(_palette(), F.concat(name, F.lit("."), F.regexp_extract(a, r"^(\w+)", 1))),
            ),
            7,
        ),
    )
    unlabelled = one(
        line.rlike("-->|==>|-.->") & ~line.rlike(DIRECTIVE_LINE) & ~(line.contains("|") & line.rlike(r"\|.*?\|")),
        "warning",
        "edge-label",
        "Edge without label: ",
        5,
    )
    every = F.concat(
        one(~_balanced(parts["bare"]), "error", "balanced-brackets", "Unbalanced brackets on line: ", 1),
        reserved,
        one(F.exists(marks, lambda m: m.contains("@")), "warning", "special-char-label", "Label contains @: ", 3),
        one(
            F.exists(marks, lambda m: m.contains("<") & m.contains(">")),
            "warning",
            "special-char-label",
            "Label contains <>: ",
            4,
        ),
        unlabelled,
        F.when(
            (name != "") & ~name.isin(*CLASSDEF_PALETTE),
            F.array(_issue("warning", "classdef-name", F.concat(F.lit("Unknown classDef name "), name), 6)),
        ).otherwise(none),
        colors,
    )
    # without a bracket, a quote or a class definition, the arrows are all there is to look at
    return F.when(parts["bare"].isNull(), unlabelled).otherwise(every)


_ISSUE = ["project", "path", "line", "level", "rule", "message", "ord"]


def extract_refs(fields: DataFrame) -> DataFrame:
    """`refs(project, source_class, target_class, node_id, pos)`: @names of each diagram, first seen first."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"@([\w-]+)"), F.lit(1)))
    return fields.where("field = 'diagram'").select(
        "project", F.col("path").alias("source_class"), F.posexplode(names).alias("pos", "target_class")
    ).select("project", "source_class", "target_class", F.concat(F.lit("@"), "target_class").alias("node_id"), "pos")


def check_refs(refs: DataFrame, elements: DataFrame, universe: str = "perspectives") -> DataFrame:
    """Status of every reference: ok, ref-self or ref-exists; `mutual` marks a reference answered back.

    `universe` is what counts as existing: top-level elements only, or `all`.
    """
    known = elements.select("project", F.col("path").alias("target_class")).distinct()
    if universe == "perspectives":
        known = known.where(~F.col("target_class").contains("/"))
    known = known.withColumn("known", F.lit(True))
    back = refs.select(
        "project",
        F.col("target_class").alias("source_class"),
        F.col("source_class").alias("target_class"),
        F.lit(True).alias("mutual"),
    ).distinct()
    status = (
        F.when(F.col("source_class") == F.col("target_class"), "ref-self")
        .when(F.col("known").isNull(), "ref-exists")
        .otherwise("ok")
    )
    return (
        refs.select("project", "source_class", "target_class")
        .join(known, ["project", "target_class"], "left")
        .join(back, ["project", "source_class", "target_class"], "left")
        .select(
            "project",
            "source_class",
            "target_class",
            status.alias("status"),
            (F.coalesce("mutual", F.lit(False)) & (status == "ok")).alias("mutual"),
        )
    )


#: What a line must hold for any rule to apply: a bracket, a quote, an arrow or a class definition.
RULED_LINE = r'(?i)[\[\](){}"]|->|=>|classDef'
#: What it must hold for any rule but that of unlabelled arrows.
MARKED_LINE = r'(?i)[\[\](){}"]|classDef'


def lint_diagrams(fields: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """Flowchart rules: one row per issue (project, path, line, level, rule, message).

    Line rules need no shuffle; reference rules join the known perspectives;
    the node-count rule aggregates the parsed nodes.  Without `elements` the
    reference rules are left out.
    """
    diagrams = fields.where("field = 'diagram'")
    content = F.filter(
        F.transform(F.split("text", "\n"), trimmed), lambda x: (x != "") & ~x.startswith("%%")
    )
    head = F.get(content, F.lit(0))
    undeclared = diagrams.where(head.isNull() | ~head.rlike(GRAPH_DECLARATION)).select(
        "project",
        "path",
        F.lit(1).alias("line"),
        F.lit("error").alias("level"),
        F.lit("graph-declaration").alias("rule"),
        F.lit("Diagram must start with a graph/flowchart direction declaration").alias("message"),
        F.lit(0).alias("ord"),
    )
    # The parts of a line that several rules look at are made once, and only where a rule could apply.
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), trimmed(x).alias("x")))
    ruled = F.filter(lines, lambda s: s["x"].rlike(RULED_LINE) & ~s["x"].startswith("%%"))
    marked = F.transform(ruled, lambda s: F.struct(s["line"].alias("line"), s["x"].alias("x"), F.when(s["x"].rlike(MARKED_LINE), s["x"]).alias("m")))
    parted = F.transform(
        marked,
        lambda s: F.struct(
            s["line"].alias("line"), s["x"].alias("x"), F.array_join(outside_quotes(s["m"]), "").alias("bare"),
            F.when(s["m"].isNotNull(), declared_node_ids(s["m"])).alias("ids"), F.when(s["m"].isNotNull(), labels(s["m"])).alias("marks"),
        ),
    )
    per_line = F.transform(parted, lambda s: F.struct(s["line"].alias("line"), _line_issues(s).alias("issues")))
    found = F.filter(per_line, lambda s: F.size(s["issues"]) > 0)
    by_line = diagrams.select("project", "path", F.inline(found)).select("project", "path", "line", F.inline("issues")).select(*_ISSUE)
    count = F.col("n")
    sizes = (
        count_rows(diagram_nodes(fields), "project", "path")
        .where((count < 3) | (count > 15))
        .select(
            "project",
            "path",
            F.lit(None).cast("int").alias("line"),
            F.lit("warning").alias("level"),
            F.lit("node-count").alias("rule"),
            F.concat(count.cast("string"), F.lit(" nodes (recommended: 5-15)")).alias("message"),
            F.lit(9).alias("ord"),
        )
    )
    out = undeclared.unionByName(by_line).unionByName(sizes)
    if elements is not None:
        out = out.unionByName(_ref_issues(extract_refs(fields), elements))
    return out


def _ref_issues(refs: DataFrame, elements: DataFrame) -> DataFrame:
    checked = check_refs(refs, elements)
    src, dst = F.col("source_class"), F.col("target_class")
    top = ~src.contains("/")
    exists = F.col("status").isin("ok") | ((F.col("status") == "ref-self") & top)
    none = F.array().cast("array<struct<level:string,rule:string,message:string,ord:int>>")

    def one(cond: Column, level: str, rule: str, text: str) -> Column:
        return F.when(cond, F.array(_issue(level, rule, F.concat(F.lit(text), dst), 8))).otherwise(none)

    single = checked.select(
        "project",
        src.alias("path"),
        F.lit(None).cast("int").alias("line"),
        F.inline(
            F.concat(
                one(F.col("status") == "ref-self", "error", "ref-self", "Diagram references its own class: @"),
                one(F.col("status") == "ref-exists", "error", "ref-exists", "No such perspective: @"),
                one(top & exists, "warning", "potential-circular-ref", "Check for a circular dependency with @"),
            )
        ),
    ).select(*_ISSUE)
    cross = (
        checked.where(top & ~src.isin(*HUB_PERSPECTIVES) & exists)
        .groupBy("project", src.alias("path"))
        .agg(F.count(F.lit(1)).alias("k"))
        .select(
            "project",
            "path",
            F.lit(None).cast("int").alias("line"),
            F.lit("warning").alias("level"),
            F.lit("perspective-cross-ref").alias("rule"),
            F.concat(F.lit("References other perspectives: "), F.col("k").cast("string")).alias("message"),
            F.lit(8).alias("ord"),
        )
    )
    return single.unionByName(cross)


# Words of the second diagram format.
SEQUENCE_PARTICIPANT = r"(?i)^(participant|actor|boundary|control|entity|database|collections|component)\s+"
SEQUENCE_OPEN = r"^(if|loop|group|alt|opt|break|critical|fork)\b"
SEQUENCE_CLOSE = r"^(endif|end|else)\b"


def lint_sequence_diagrams(fields: DataFrame) -> DataFrame:
    """Rules of the sequence format.  Block depth never drops below zero, so it is a fold over the lines."""
    text = trimmed(F.col("text"))
    lines = F.transform(F.split(text, "\n"), trimmed)
    people = F.size(F.filter(lines, lambda x: x.rlike(SEQUENCE_PARTICIPANT)))
    messages = F.size(
        F.filter(lines, lambda x: x.rlike("->|<-") & ~x.startswith("//") & ~x.startswith("'"))
    )
    depth = F.aggregate(
        F.transform(lines, F.lower),
        F.lit(0),
        lambda acc, x: F.greatest(
            acc + F.when(x.rlike(SEQUENCE_OPEN), 1).otherwise(0) - F.when(x.rlike(SEQUENCE_CLOSE), 1).otherwise(0),
            F.lit(0),
        ),
    )
    facts = fields.where("field = 'diagram'").select(
        "project",
        "path",
        (text == "").alias("blank"),
        text.rlike("(?i)@startuml").alias("starts"),
        text.rlike("(?i)@enduml").alias("ends"),
        people.alias("people"),
        messages.alias("messages"),
        depth.alias("depth"),
    )
    none = F.array().cast("array<struct<level:string,rule:string,message:string,ord:int>>")

    def one(cond: Column, level: str, rule: str, message: Column, order: int) -> Column:
        return F.when(cond, F.array(_issue(level, rule, message, order))).otherwise(none)

    full = ~F.col("blank")
    issues = F.concat(
        one(F.col("blank"), "error", "empty-diagram", F.lit("Diagram is empty."), 0),
        one(full & ~F.col("starts"), "error", "missing-startuml", F.lit("Missing @startuml tag."), 1),
        one(full & ~F.col("ends"), "error", "missing-enduml", F.lit("Missing @enduml tag."), 2),
        one(full & (F.col("people") == 1), "warning", "few-participants", F.lit("Only 1 participant(s)."), 3),
        one(full & (F.col("people") > 0) & (F.col("messages") == 0), "warning", "no-messages", F.lit("No messages found."), 4),
        one(
            full & (F.col("depth") != 0),
            "warning",
            "unbalanced-blocks",
            F.concat(F.lit("Unbalanced block structure (depth: "), F.col("depth").cast("string"), F.lit(")")),
            5,
        ),
    )
    return facts.select("project", "path", F.lit(None).cast("int").alias("line"), F.inline(issues)).select(*_ISSUE)


def lint_by_format(fields: DataFrame, elements: DataFrame) -> DataFrame:
    """Lint each diagram by its `format` column ('sequence', anything else is a flowchart)."""
    seq = F.coalesce(F.col("format"), F.lit("flowchart")) == "sequence"
    return lint_diagrams(fields.where(~seq), elements).unionByName(lint_sequence_diagrams(fields.where(seq)))


# ---- repair -------------------------------------------------------------------


def _escape_label(c: Column) -> Column:
    return F.replace(
        F.replace(F.replace(c, F.lit("@"), F.lit("→")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")
    )


def _fix_labels(line: Column) -> Column:
    """Replace @ and escape <> in quoted texts and in bracketed text outside quotes."""

    def outside(part: Column) -> Column:
        tokens = F.regexp_extract_all(
            part, F.lit(r"([\[(\{][^\]\})]*[\]\})]|[\[(\{][^\]\})]*$|[^\[(\{]+)"), F.lit(1)
        )
        return F.array_join(
            F.transform(tokens, lambda t: F.when(t.rlike(r"^[\[(\{][^\]\})]*[\]\})]$"), _escape_label(t)).otherwise(t)), ""
        )

    parts = F.split(line, '"', -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, _escape_label(p)).otherwise(outside(p))), '"')


def _fix_colors(line: Column) -> Column:
    pattern = r"(?i)^(\s*classDef\s+\w+\s+)(.+)$"
    name = F.regexp_extract(line, r"(?i)classDef\s+(\w+)", 1)

    def part(p: Column) -> Column:
        attr = F.regexp_extract(p, r"^\s*(\w+)\s*:\s*(#[0-9a-fA-F]{3,8})\s*$", 1)
        value = F.lower(F.regexp_extract(p, r"^\s*(\w+)\s*:\s*(#[0-9a-fA-F]{3,8})\s*$", 2))
        want = F.try_element_at(_palette(), F.concat(name, F.lit("."), attr))
        return F.when(want.isNotNull() & (want != value), F.concat(F.lit(" "), attr, F.lit(":"), want)).otherwise(p)

    attrs = F.transform(F.split(F.regexp_extract(line, pattern, 2), ",", -1), part)
    return F.when(
        line.rlike(pattern), F.concat(F.regexp_extract(line, pattern, 1), F.array_join(attrs, ","))
    ).otherwise(line)


def _rename(line: Column, ids: Column) -> Column:
    """Append -node to each of `ids` where it stands for a node: outside quotes, comments and headers."""
    t = trimmed(line)
    fixed = (
        (t == "")
        | t.startswith("%%")
        | t.rlike(GRAPH_DECLARATION)
        | t.rlike(r"(?i)^subgraph\s+")
        | (t == "end")
        | t.startswith("end ")
        | t.startswith("classDef ")
    )
    at = F.locate("%%", line)
    code = F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line)
    comment = F.when(at > 0, F.substring(line, at, F.length(line))).otherwise(F.lit(""))

    def swap(text: Column) -> Column:
        return F.aggregate(
            ids,
            text,
            lambda acc, i: F.regexp_replace(acc, F.concat(F.lit(r"\b"), i, F.lit(r"\b")), F.concat(i, F.lit("-node"))),
        )

    parts = F.transform(F.split(code, '"', -1), lambda p, i: F.when(i % 2 == 0, swap(p)).otherwise(p))
    return F.when(fixed, line).otherwise(F.concat(F.array_join(parts, '"'), comment))


def repair_diagrams(fields: DataFrame) -> DataFrame:
    """Fix wrong class colours, reserved node names and special characters in labels.

    Returns (project, path, text, fixed, changed).  Each diagram is repaired in
    its own row by mapping over its lines.
    """
    # an id is declared by an opening bracket
    opened = F.filter(F.col("lines"), lambda x: x.rlike(r"[\[(\{]"))
    reserved = F.array_distinct(
        F.flatten(F.transform(opened, lambda x: F.filter(declared_node_ids(trimmed(x)), lambda i: F.lower(i).isin(*RESERVED_WORDS))))
    )
    base = _once(fields.where("field = 'diagram'").select("project", "path", "text"), lines=F.split("text", "\n", -1))
    base = _once(base, reserved=reserved)

    def special(x: Column) -> Column:
        return F.exists(labels(trimmed(x)), lambda m: m.contains("@") | (m.contains("<") & m.contains(">")))

    # each repair looks only at the lines that hold what it repairs
    marked = F.transform("lines", lambda x: F.when(x.rlike("[@<]") & special(x), _fix_labels(x)).otherwise(x))
    renamed = F.when(F.size("reserved") == 0, marked).otherwise(F.transform(marked, lambda x: _rename(x, F.col("reserved"))))
    colored = F.transform(renamed, lambda x: F.when(x.rlike("(?i)classDef"), _fix_colors(x)).otherwise(x))
    return _once(base, fixed=F.array_join(colored, "\n")).select("project", "path", "text", "fixed", (F.col("fixed") != F.col("text")).alias("changed"))


def repair_report(issues: DataFrame) -> DataFrame:
    """Each lint issue with `fixed`: the first issue that triggers a repair is fixed by it.

    Later issues of the same repair find nothing left to change and stay
    reported, as do all issues without an automatic repair.
    """
    group = (
        F.when(F.col("rule") == "reserved-word", F.col("message"))
        .when(F.col("rule").isin("classdef-color", "special-char-label"), F.concat(F.col("rule"), F.lit(":"), F.col("line")))
    )
    tagged = issues.withColumn("repair", group)
    firsts = (
        tagged.where("repair IS NOT NULL")
        .groupBy("project", "path", "repair")
        .agg(F.min(F.struct("line", "ord", "message")).alias("f"))
    )
    return (
        tagged.join(firsts, ["project", "path", "repair"], "left")
        .withColumn("fixed", F.coalesce(F.struct("line", "ord", "message") == F.col("f"), F.lit(False)))
        .drop("repair", "f")
    )


# ---- comparing ------------------------------------------------------------------


def diagram_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes and edges added to or removed from each diagram (two `fields` tables)."""

    def items(fields: DataFrame) -> DataFrame:
        nodes = diagram_nodes(fields).select("project", "path", F.lit("node").alias("what"), F.col("node").alias("item"))
        edges = diagram_edges(fields).select(
            "project", "path", F.lit("edge").alias("what"), F.concat_ws(" ", "src", "arrow", "dst").alias("item")
        )
        return nodes.unionByName(edges)

    keys = ["project", "path", "what", "item"]
    side = items(before).withColumn("b", F.lit(1)).join(items(after).withColumn("a", F.lit(1)), keys, "full_outer")
    return side.where("b IS NULL OR a IS NULL").select(
        *keys, F.when(F.col("b").isNull(), "added").otherwise("removed").alias("change")
    )


def line_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Positional line differences of two versions (project, path, text); blank lines never show."""

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.select("project", "path", F.posexplode(F.split("text", "\n")).alias("line_no", name))

    keys = ["project", "path", "line_no"]
    both = rows(before, "old").join(rows(after, "new"), keys, "full_outer").select(
        *keys, F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new")
    )
    sides = F.filter(
        F.array(
            F.struct(F.lit("-").alias("sign"), F.col("old").alias("line")),
            F.struct(F.lit("+").alias("sign"), F.col("new").alias("line")),
        ),
        lambda s: s["line"] != "",
    )
    return both.where("old <> new").select(*keys, F.inline(sides))


def undocumented_dependencies(edges: DataFrame, drawn: DataFrame) -> DataFrame:
    """Actual dependencies (base names) no diagram draws as a plain arrow."""
    actual = edges.select(
        "project", stem_of(base_of(F.col("src"))).alias("src"), stem_of(base_of(F.col("dst"))).alias("dst")
    ).distinct()
    clean = lambda c: trimmed(F.substring_index(F.regexp_replace(c, r"[\"'\[\](){}]", ""), "\\n", 1))
    documented = drawn.where("arrow = '-->'").select("project", clean(F.col("src")).alias("src"), clean(F.col("dst")).alias("dst"))
    return actual.join(documented.distinct(), ["project", "src", "dst"], "left_anti")


def dependency_counts(edges: DataFrame, drawn: DataFrame) -> DataFrame:
    """Documented, actual and missing dependencies of each project."""
    documented = count_rows(
        drawn.select("project", "src", "arrow", "dst").distinct(), "project", name="documented_edges"
    )
    actual = count_rows(
        edges.select(
            "project", stem_of(base_of(F.col("src"))).alias("a"), stem_of(base_of(F.col("dst"))).alias("b")
        ).distinct(),
        "project",
        name="actual_edges",
    )
    missing = count_rows(undocumented_dependencies(edges, drawn), "project", name="missing_edges")
    return (
        actual.join(documented, "project", "left")
        .join(missing, "project", "left")
        .fillna(0, ["documented_edges", "missing_edges"])
    )


def undocumented_diagram_nodes(fields: DataFrame, elements: DataFrame) -> DataFrame:
    """Diagram nodes of perspectives and their direct children that have no element below."""
    known = elements.select("project", F.col("path").alias("child")).distinct()
    shallow = F.size(F.split("path", "/")) <= 2
    nodes = diagram_nodes(fields.where(shallow)).where(
        ~F.col("node").startswith("@") & ~F.col("node").startswith("__")
    )
    missing = nodes.withColumn("child", F.concat("path", F.lit("/"), "node")).join(known, ["project", "child"], "left_anti")
    # one row per diagram on both sides, so a text is never copied per node
    per = missing.groupBy("project", "path").agg(F.collect_list("node").alias("nodes"))
    texts = fields.where("field = 'diagram'").where(shallow).select("project", "path", "text")

    def label(node: Column) -> Column:
        pattern = F.concat(F.lit(r"\Q"), node, F.lit(r'\E\["([^"]+)"\]'))
        found = F.call_function("regexp_extract", F.col("text"), pattern, F.lit(1))
        return F.when(found == "", node).otherwise(F.replace(found, F.lit("\\n"), F.lit(" — ")))

    rows = F.transform("nodes", lambda n: F.struct(n.alias("node"), label(n).alias("label")))
    return per.join(texts, ["project", "path"]).select("project", "path", F.inline(rows))
