"""Quality of documentation: scores, issues, rankings, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.functions.common import count_rows, half_up, top_n
from arborist.functions.paths import base_of, depth_of, parent_of
from arborist.functions.rules import FIELDS
from arborist.operators.diagrams import check_refs, extract_refs, undocumented_diagram_nodes
from arborist.operators.docs import KEYS, children_coverage, element_types, field_stats

# The most each part of a score can earn.
PART_MAX = {"fields": 40.0, "diagram": 20.0, "description": 10.0, "flows": 10.0, "refs": 10.0, "children": 10.0}


def score_elements(
    elements: DataFrame, fields: DataFrame, flows: DataFrame, refs: DataFrame, issues: DataFrame
) -> DataFrame:
    """Score (0-100) and six parts for perspectives and their direct children.

    `issues` is the lint result; an element with an error has an invalid
    diagram.  Texts are reduced to flags and lengths before anything shuffles.
    """
    scope = elements.select(*KEYS).where(depth_of(F.col("path")) <= 2)
    flags = (
        fields.where(depth_of(F.col("path")) <= 2)
        .select(*KEYS, "field", F.length("text").alias("len"), F.col("text").rlike(r"\S").alias("present"))
        .groupBy(*KEYS)
        .agg(
            F.count_if("present").alias("fields_present"),
            F.bool_or((F.col("field") == "diagram") & F.col("present")).alias("has_diagram"),
            F.max(F.when((F.col("field") == "description") & F.col("present"), F.col("len"))).alias("description_length"),
            *[F.bool_or((F.col("field") == f) & F.col("present")).alias(f"has_{f}_") for f in FIELDS],
        )
    )
    bad = issues.where("level = 'error'").select(*KEYS, F.lit(True).alias("invalid")).distinct()
    flow_count = count_rows(flows, *KEYS, name="flow_count")
    out_refs = count_rows(refs.select("project", F.col("source_class").alias("path")), *KEYS, name="refs_out")
    in_refs = count_rows(
        refs.where("NOT contains(source_class, '/') AND source_class <> target_class").select(
            "project", F.col("target_class").alias("path")
        ),
        *KEYS,
        name="refs_in",
    )
    kids = children_coverage(elements, fields)
    joined = scope
    for part in (flags, bad, flow_count, out_refs, in_refs, kids):
        joined = joined.join(part, KEYS, "left")
    numbers = ["fields_present", "description_length", "flow_count", "refs_out", "refs_in", "children", "covered"]
    joined = joined.fillna(0, numbers).fillna(False, ["has_diagram", "invalid", *[f"has_{f}_" for f in FIELDS]])
    c = F.col
    earned = {
        "fields": c("fields_present") / len(FIELDS) * 40,
        "diagram": F.when(c("has_diagram") & ~c("invalid"), 20.0).when(c("has_diagram"), 10.0).otherwise(0.0),
        "description": F.when(c("description_length") > 50, 10.0).when(c("description_length") > 20, 5.0).otherwise(0.0),
        "flows": F.when(c("flow_count") > 0, 10.0).otherwise(0.0),
        "refs": F.when((c("refs_in") > 0) | (c("refs_out") > 0), 10.0).otherwise(0.0),
        "children": F.when(c("children") == c("covered"), 10.0).otherwise(c("covered") / c("children") * 10),
    }
    total = sum((earned[p] for p in PART_MAX), F.lit(0.0))
    missing = F.array_compact(F.array(*[F.when(~c(f"has_{f}_"), F.lit(f)) for f in FIELDS]))
    return joined.select(
        *KEYS,
        F.when(~c("path").contains("/"), "perspective").when(c("has_diagram"), "group").otherwise("leaf").alias("type"),
        "fields_present",
        F.array_join(missing, ",").alias("fields_missing"),
        "has_diagram",
        (c("has_diagram") & ~c("invalid")).alias("diagram_valid"),
        "description_length",
        "flow_count",
        "refs_in",
        "refs_out",
        "children",
        "covered",
        *[e.alias(f"{p}_points") for p, e in earned.items()],
        half_up(total).alias("score"),
    )


def score_penalties(
    undocumented: DataFrame, broken_refs: DataFrame, orphans: DataFrame, stale: DataFrame, projects: DataFrame
) -> DataFrame:
    """Points off per project: undocumented nodes, broken references, orphaned sources, stale signature."""
    u = count_rows(undocumented, "project", name="undocumented")
    b = count_rows(broken_refs, "project", name="broken")
    o = count_rows(orphans, "project", name="orphaned")
    s = stale.where("state = 'stale'").select("project", F.lit(1).alias("stale"))
    out = projects.select("project").distinct()
    for part in (u, b, o, s):
        out = out.join(part, "project", "left")
    out = out.fillna(0, ["undocumented", "broken", "orphaned", "stale"])
    c = F.col
    points = (
        F.least(F.lit(10).cast("bigint"), F.ceil(c("undocumented") / 10))
        + F.least(F.lit(10).cast("bigint"), c("broken") * 2)
        + F.least(F.lit(5).cast("bigint"), F.ceil(c("orphaned") / 5))
        + F.when(c("stale") == 1, 2).otherwise(0)
    )
    return out.select("project", "undocumented", "broken", "orphaned", (c("stale") == 1).alias("stale"), points.alias("penalty"))


def score_projects(scores: DataFrame, penalties: DataFrame | None = None) -> DataFrame:
    """Project summary: counts by type, coverages, raw and overall score."""
    c = F.col
    pct = lambda x: half_up(x * 100)
    n = F.count(F.lit(1))
    per = scores.groupBy("project").agg(
        n.alias("elements"),
        F.count_if(c("type") == "perspective").alias("perspectives"),
        F.count_if(c("type") == "leaf").alias("leaves"),
        F.count_if(c("type") == "group").alias("groups"),
        pct(F.sum("fields_present") / (n * len(FIELDS))).alias("field_coverage"),
        pct(F.count_if(c("has_diagram")) / n).alias("diagram_coverage"),
        pct(F.count_if(c("flow_count") > 0) / n).alias("flow_coverage"),
        pct(F.count_if((c("refs_in") > 0) | (c("refs_out") > 0)) / n).alias("ref_integrity"),
        half_up(F.sum("score") / n).alias("raw_score"),
    )
    if penalties is None:
        return per.withColumn("overall_score", c("raw_score"))
    return (
        per.join(penalties.select("project", "penalty"), "project", "left")
        .fillna(0, ["penalty"])
        .withColumn("overall_score", F.greatest(F.lit(0).cast("bigint"), c("raw_score") - c("penalty")))
    )


def quality_gate(
    summary: DataFrame, threshold: int, minima: dict[str, int] | None = None
) -> DataFrame:
    """Whether each project passes: overall score, and optional minima of the coverages."""
    ok = F.col("overall_score") >= threshold
    for name, least in (minima or {}).items():
        ok = ok & (F.col(name) >= least)
    return summary.select("project", "overall_score", ok.alias("passed"))


# Minima of the stricter gate.
GATE_MINIMA = {"field_coverage": 50, "diagram_coverage": 50, "flow_coverage": 30, "ref_integrity": 20}


def quality_issues(
    scores: DataFrame,
    undocumented: DataFrame,
    corrupted_tags: DataFrame | None = None,
    stale: DataFrame | None = None,
    orphans: DataFrame | None = None,
    broken_refs: DataFrame | None = None,
) -> DataFrame:
    """Issue rows (project, path, type, severity, amount).  One pass over the scores, then project-level rows."""
    c = F.col
    kind = "array<struct<type:string,severity:string,amount:bigint>>"

    def one(cond: Column, name: str, severity: str, amount: Column) -> Column:
        row = F.struct(
            F.lit(name).alias("type"), F.lit(severity).alias("severity"), amount.cast("bigint").alias("amount")
        )
        return F.when(cond, F.array(row)).otherwise(F.array().cast(kind))

    upper = c("type").isin("group", "perspective")
    found = F.concat(
        one(c("description_length") == 0, "missing-description", "warning", F.lit(1)),
        one(c("has_diagram") & ~c("diagram_valid"), "invalid-diagram", "error", F.lit(1)),
        one(upper & (c("covered") < c("children")), "incomplete-children", "warning", c("children") - c("covered")),
        one(c("fields_present") < len(FIELDS) - 3, "sparse-fields", "info", c("fields_present")),
        one((c("type") == "perspective") & (c("flow_count") == 0), "no-flows", "info", F.lit(1)),
    )
    rows = scores.select(*KEYS, F.inline(found))
    cols = ["project", "path", "type", "severity", "amount"]

    def add(df: DataFrame, path: Column, name: str, severity: str, amount: Column) -> None:
        nonlocal rows
        rows = rows.unionByName(
            df.select(
                "project",
                path.alias("path"),
                F.lit(name).alias("type"),
                F.lit(severity).alias("severity"),
                amount.cast("bigint").alias("amount"),
            )
        )

    none = F.lit(None).cast("string")
    add(undocumented, F.concat("path", F.lit("/"), "node"), "undocumented-diagram-node", "warning", F.lit(1))
    if corrupted_tags is not None:
        add(corrupted_tags.where("corrupted > 0"), c("path"), "corrupted-tags", "warning", c("corrupted"))
    if stale is not None:
        add(stale.where("state = 'stale'"), none, "stale-signature", "info", F.lit(1))
    if orphans is not None:
        add(count_rows(orphans, "project"), none, "orphaned-sources", "warning", c("n"))
    if broken_refs is not None:
        add(count_rows(broken_refs, "project"), none, "broken-refs", "warning", c("n"))
    return rows.select(*cols)


def issue_counts(issues: DataFrame) -> DataFrame:
    return count_rows(issues, "project", "severity", name="issues")


def quick_score(elements: DataFrame, fields: DataFrame, issues: DataFrame) -> DataFrame:
    """Second, simpler project score over perspectives: no references, flows or children."""
    c = F.col
    top = ~c("path").contains("/")
    flags = (
        fields.where(top)
        .select(*KEYS, "field", F.col("text").rlike(r"\S").alias("present"), (F.length("text") > 0).alias("any"), F.length("text").alias("len"))
        .groupBy(*KEYS)
        .agg(
            F.count_if("present").alias("n"),
            *[F.bool_or((c("field") == f) & c("any")).alias(f) for f in FIELDS],
            F.max(F.when(c("field") == "description", c("len"))).alias("len"),
        )
    )
    bad = issues.where("level = 'error' AND rule NOT IN ('ref-self', 'ref-exists')").select(*KEYS, F.lit(True).alias("invalid")).distinct()
    joined = elements.where(top).select(*KEYS).join(flags, KEYS, "left").join(bad, KEYS, "left")
    joined = joined.fillna(0, ["n", "len"]).fillna(False, [*FIELDS, "invalid"])
    points = lambda cond, p: F.when(cond, p).otherwise(0.0)
    score = (
        c("n") / len(FIELDS) * 40
        + F.when(c("diagram") & ~c("invalid"), 20.0).when(c("diagram"), 10.0).otherwise(0.0)
        + points(c("len") > 50, 10.0)
        + points(c("context"), 5.0)
        + points(c("constraint"), 5.0)
        + points(c("concern"), 5.0)
        + points(c("todo"), 2.5)
        + points(c("note"), 2.5)
    )
    n = F.count(F.lit(1))
    return joined.withColumn("score", score).groupBy("project").agg(
        half_up(F.round(F.sum("score") / n, 9)).alias("score"),
        n.alias("elements"),
        half_up(F.sum("n") / (n * len(FIELDS)) * 100).alias("field_coverage"),
        half_up(F.count_if("diagram") / n * 100).alias("diagram_coverage"),
        F.count_if(c("diagram") & ~c("invalid")).alias("valid_diagrams"),
    )


def improvement_ranking(scores: DataFrame, n: int = 10) -> DataFrame:
    """Elements with most to gain, and the gain per part."""
    gains = {p: F.lit(m) - F.col(f"{p}_points") for p, m in PART_MAX.items()}
    rows = scores.select(
        *KEYS, "type", *[g.alias(f"gain_{p}") for p, g in gains.items()], F.round(sum(gains.values(), F.lit(0.0)), 9).alias("gap")
    ).where("gap > 0")
    return top_n(rows, ["project"], [F.desc("gap"), F.asc("path")], n)


def worst_elements(scores: DataFrame, below: int = 80, n: int = 10) -> DataFrame:
    return top_n(
        scores.where(F.col("score") < below).select(*KEYS, "type", "score", "fields_missing"),
        ["project"],
        [F.asc("score"), F.asc("path")],
        n,
    )


def feedback_report(summary: DataFrame, scores: DataFrame, issues: DataFrame) -> DataFrame:
    """One nested row per project: summary, ten worst elements, issue counts.

    The lists hold at most ten elements and three severities, so gathering them is bounded.
    """
    worst = worst_elements(scores).groupBy("project").agg(
        F.sort_array(F.collect_list(F.struct("score", "path", "type", "fields_missing"))).alias("lowest")
    )
    counts = issue_counts(issues).groupBy("project").agg(
        F.sort_array(F.collect_list(F.struct("severity", "issues"))).alias("issues")
    )
    packed = summary.select("project", F.struct(*[c for c in summary.columns if c != "project"]).alias("summary"))
    return packed.join(worst, "project", "left").join(counts, "project", "left")


def reconcile_report(elements: DataFrame, fields: DataFrame, orphans: DataFrame) -> DataFrame:
    """Drift rows (project, path, kind, detail): orphaned sources, missing texts, broken references, empty elements.

    References count as broken when no element of any depth has their name.
    """
    c = F.col
    present = (
        fields.select(*KEYS, "field", F.col("text").rlike(r"\S").alias("present"))
        .groupBy(*KEYS)
        .agg(
            F.bool_or(c("field") == "description").alias("described"),
            F.bool_or(c("field") == "diagram").alias("drawn"),
            F.bool_or("present").alias("filled"),
        )
    )
    state = elements.select(*KEYS).join(present, KEYS, "left").fillna(False, ["described", "drawn", "filled"])
    kinds = F.array_compact(
        F.array(
            F.when(~c("described"), "missing_description"),
            F.when(~c("drawn"), "missing_diagram"),
            F.when(~c("filled"), "empty_element"),
        )
    )
    none = F.lit(None).cast("string")
    gaps = state.select(*KEYS, F.explode(kinds).alias("kind"), none.alias("detail"))
    broken = check_refs(extract_refs(fields), elements, "all").where("status = 'ref-exists'")
    return (
        gaps.unionByName(orphans.select(*KEYS, F.lit("orphaned_source").alias("kind"), F.col("file").alias("detail")))
        .unionByName(
            broken.select(
                "project", c("source_class").alias("path"), F.lit("broken_ref").alias("kind"), c("target_class").alias("detail")
            )
        )
    )


def has_issues(report: DataFrame, signatures: DataFrame) -> DataFrame:
    """Whether each project needs attention: stale signature, orphans, broken references, empty elements."""
    serious = report.where("kind IN ('orphaned_source', 'broken_ref', 'empty_element')").select("project", F.lit(True).alias("bad"))
    stale = signatures.select("project", (F.col("state") != "ok").alias("bad"))
    return serious.unionByName(stale).groupBy("project").agg(F.bool_or("bad").alias("has_issues"))


def inspect_elements(
    elements: DataFrame, fields: DataFrame, scores: DataFrame, plan: DataFrame, links: DataFrame | None = None
) -> DataFrame:
    """One row per element: type, coverage, words, score, tracking status, links and children counts.

    Children with their scores, which have no bound, are `inspect_children`.
    """
    facts = (
        field_stats(fields)
        .groupBy(*KEYS)
        .agg(
            F.count_if("present").alias("fields_present"),
            F.sum("words").alias("words"),
            F.bool_or((F.col("field") == "diagram") & F.col("present")).alias("has_diagram"),
        )
    )
    kids = children_coverage(elements, fields)
    out = elements.select(*KEYS).join(facts, KEYS, "left").join(kids, KEYS, "left")
    out = out.join(scores.select(*KEYS, "score"), KEYS, "left").join(plan.select(*KEYS, "status", "reasons"), KEYS, "left")
    if links is not None:
        out = out.join(count_rows(links, *KEYS, name="links"), KEYS, "left")
    else:
        out = out.withColumn("links", F.lit(0).cast("bigint"))
    out = out.fillna(0, ["fields_present", "words", "children", "covered", "score", "links"]).fillna(False, ["has_diagram"])
    return out.select(
        *KEYS,
        F.when(~F.col("path").contains("/"), "perspective").when(F.col("has_diagram"), "group").otherwise("leaf").alias("type"),
        half_up(F.col("fields_present") / len(FIELDS) * 100).alias("field_coverage"),
        "words",
        "score",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        "reasons",
        "links",
        "children",
        "covered",
    )


def inspect_children(elements: DataFrame, fields: DataFrame, scores: DataFrame) -> DataFrame:
    """Children of every element, one row each, with type, diagram flag and score."""
    types = element_types(elements.where(F.col("path").contains("/")), fields)
    return types.join(scores.select(*KEYS, "score"), KEYS, "left").select(
        "project",
        parent_of(F.col("path")).alias("parent"),
        base_of(F.col("path")).alias("name"),
        "type",
        (F.col("type") == "group").alias("has_diagram"),
        F.coalesce("score", F.lit(0).cast("bigint")).alias("score"),
    )
