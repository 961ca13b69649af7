"""Documentation elements: types, references, trees, metrics, signatures, edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.functions.common import count_rows, half_up
from arborist.functions.paths import base_of, depth_of, parent_of, trimmed
from arborist.functions.rules import FIELDS
from arborist.functions.text import lane_digest, word_count
from arborist.operators.diagrams import diagram_edges, diagram_nodes, extract_refs

KEYS = ["project", "path"]


def filled(fields: DataFrame) -> DataFrame:
    return fields.where(F.col("text").rlike(r"\S"))


def element_types(elements: DataFrame, fields: DataFrame) -> DataFrame:
    """perspective (top level), group (has a diagram) or leaf."""
    drawn = filled(fields).where("field = 'diagram'").select(*KEYS, F.lit(True).alias("drawn")).distinct()
    kind = (
        F.when(~F.col("path").contains("/"), "perspective").when(F.col("drawn"), "group").otherwise("leaf")
    )
    return elements.select(*KEYS).join(drawn, KEYS, "left").select(*KEYS, kind.alias("type"))


def tag_filter(elements: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Elements carrying all of the tags, whatever their case."""
    own = F.transform("tags", F.lower)
    cond = F.lit(True)
    for t in tags:
        cond = cond & F.array_contains(own, t.lower())
    return elements.where(cond)


def split_tags(raw: DataFrame) -> DataFrame:
    """Tags given as a JSON list: the strings kept, the rest counted as corrupted."""
    inner = F.regexp_replace("tags_json", r"^\s*\[|\]\s*$", "")
    items = F.regexp_extract_all(
        inner, F.lit(r'("(?:[^"\\]|\\.)*"|\{[^{}]*\}|\[[^\[\]]*\]|[^\s,"\[\]{}]+)'), F.lit(1)
    )
    texts = F.filter(items, lambda t: t.startswith('"'))
    return raw.select(
        *KEYS,
        F.coalesce(
            F.from_json(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")), "array<string>"),
            F.array().cast("array<string>"),
        ).alias("tags"),
        (F.size(items) - F.size(texts)).alias("corrupted"),
    )


# ---- references ----------------------------------------------------------------


def ref_graph(fields: DataFrame) -> DataFrame:
    """All references between perspectives' diagrams and what they name."""
    top = fields.where(~F.col("path").contains("/"))
    return extract_refs(top).select("project", "source_class", "target_class", "node_id")


def outgoing_refs(fields: DataFrame) -> DataFrame:
    """What each element references: @names in its diagram and arrows leaving it in its parent's diagram."""
    own = extract_refs(fields).select("project", F.col("source_class").alias("path"), F.col("target_class").alias("target"))
    drawn = diagram_edges(fields).where("arrow = '-->'")
    by_parent = drawn.select("project", F.concat("path", F.lit("/"), "src").alias("path"), F.col("dst").alias("target"))
    return own.unionByName(by_parent).distinct()


def incoming_refs(fields: DataFrame) -> DataFrame:
    """Who references each element: perspectives naming it and arrows into it in its parent's diagram."""
    top = extract_refs(fields.where(~F.col("path").contains("/"))).where("source_class <> target_class")
    named = top.select("project", F.col("target_class").alias("path"), F.col("source_class").alias("source"))
    drawn = diagram_edges(fields).where("arrow = '-->'")
    by_parent = drawn.select("project", F.concat("path", F.lit("/"), "dst").alias("path"), F.col("src").alias("source"))
    return named.unionByName(by_parent).distinct()


# ---- trees ------------------------------------------------------------------------


def element_tree(elements: DataFrame, fields: DataFrame) -> DataFrame:
    """Listing rows: depth, name, last-child flag, short description, diagram flag, sort key.

    `ORDER BY project, sort_key` is the pre-order: the key is the array of path
    segments, because '/' sorts after '-' in plain text.
    """
    one_line = trimmed(F.regexp_replace("text", "\n", " "))
    short = F.when(F.length(one_line) > 60, F.concat(F.substring(one_line, 1, 57), F.lit("..."))).otherwise(one_line)
    facts = (
        filled(fields)
        .where(F.col("field").isin("description", "diagram"))
        .select(*KEYS, "field", F.when(F.col("field") == "description", short).alias("short"))
        .groupBy(*KEYS)
        .agg(F.max("short").alias("description"), F.bool_or(F.col("field") == "diagram").alias("has_diagram"))
    )
    placed = elements.select(
        *KEYS,
        (depth_of(F.col("path")) - 1).alias("depth"),
        base_of(F.col("path")).alias("name"),
        F.coalesce(parent_of(F.col("path")), F.lit("")).alias("parent"),
    )
    last = placed.groupBy("project", "parent").agg(F.max("name").alias("name")).withColumn("is_last", F.lit(True))
    return (
        placed.join(facts, KEYS, "left")
        .join(last, ["project", "parent", "name"], "left")
        .select(
            *KEYS,
            "depth",
            "name",
            F.coalesce("is_last", F.lit(False)).alias("is_last"),
            "description",
            F.coalesce("has_diagram", F.lit(False)).alias("has_diagram"),
            F.split("path", "/").alias("sort_key"),
        )
    )


def children_coverage(elements: DataFrame, fields: DataFrame) -> DataFrame:
    """Children of each parent and how many of them have a diagram."""
    drawn = filled(fields).where("field = 'diagram'").select(*KEYS, F.lit(1).alias("drawn")).distinct()
    return (
        elements.where(F.col("path").contains("/"))
        .select(*KEYS)
        .join(drawn, KEYS, "left")
        .groupBy("project", parent_of(F.col("path")).alias("path"))
        .agg(F.count(F.lit(1)).alias("children"), F.count("drawn").alias("covered"))
    )


# ---- metrics -------------------------------------------------------------------------


def field_stats(fields: DataFrame) -> DataFrame:
    """Words of each field of each element."""
    return fields.select(*KEYS, "field", F.col("text").rlike(r"\S").alias("present"), word_count(F.col("text")).alias("words"))


def element_metrics(elements: DataFrame, fields: DataFrame) -> DataFrame:
    """Words, coverage, diagram size and complexity, children of each element."""
    words = (
        field_stats(fields)
        .where("present")
        .groupBy(*KEYS)
        .agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("present"))
    )
    n = count_rows(diagram_nodes(fields), *KEYS, name="diagram_nodes")
    e = count_rows(diagram_edges(fields), *KEYS, name="diagram_edges")
    kids = count_rows(
        elements.where(F.col("path").contains("/")).select("project", parent_of(F.col("path")).alias("path")),
        *KEYS,
        name="children",
    )
    out = elements.select(*KEYS)
    for part in (words, n, e, kids):
        out = out.join(part, KEYS, "left")
    out = out.fillna(0, ["words", "present", "diagram_nodes", "diagram_edges", "children"])
    return out.select(
        *KEYS,
        "words",
        half_up(F.col("present") / len(FIELDS) * 100).alias("coverage_pct"),
        "diagram_nodes",
        "diagram_edges",
        F.when(F.col("diagram_nodes") > 15, "high").when(F.col("diagram_nodes") > 8, "medium").otherwise("low").alias("complexity"),
        "children",
    )


def signature(elements: DataFrame) -> DataFrame:
    """Structural signature of each project: digest of its set of element paths."""
    counts = elements.groupBy("project").agg(F.count_if(~F.col("path").contains("/")).alias("perspectives"))
    digest = lane_digest(elements.select(*KEYS), ["project"], "path")
    return digest.join(counts, "project").select(
        "project",
        F.concat(F.lit("sha256:"), "digest").alias("signature"),
        F.col("n_items").alias("element_count"),
        "perspectives",
    )


def check_signature(elements: DataFrame, signatures: DataFrame) -> DataFrame:
    """Current against stored signature (project, signature): ok, stale or unset."""
    stored = signatures.select("project", F.col("signature").alias("stored"))
    state = F.when(F.col("stored").isNull(), "unset").when(F.col("stored") == F.col("signature"), "ok").otherwise("stale")
    return signature(elements).join(stored, "project", "left").select("project", "signature", "stored", state.alias("state"))


def project_summary(elements: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Perspectives, elements, last update and number of updates of each project."""
    base = elements.groupBy("project").agg(
        F.count_if(~F.col("path").contains("/")).alias("perspectives"), F.count(F.lit(1)).alias("elements")
    )
    if history is None:
        return base
    past = history.groupBy("project").agg(F.max("written_at").alias("last_update"), F.count(F.lit(1)).alias("updates"))
    return base.join(past, "project", "full_outer").fillna(0, ["perspectives", "elements", "updates"])


def network_graph(elements: DataFrame, fields: DataFrame) -> DataFrame:
    """Edges of the whole documentation: drawn in a perspective, containment, shared between perspectives."""
    top = fields.where(~F.col("path").contains("/"))
    at = lambda c: F.concat("path", F.lit("/"), c)
    drawn = diagram_edges(top).select("project", at("src").alias("src"), at("dst").alias("dst"), F.lit("drawn").alias("kind")).distinct()
    nodes = diagram_nodes(top)
    inside = nodes.select("project", F.col("path").alias("src"), at("node").alias("dst"), F.lit("contains").alias("kind"))
    parts = F.split("path", "/")
    children = elements.where(F.size(parts) == 2).select("project", F.get(parts, F.lit(0)).alias("other"), F.get(parts, F.lit(1)).alias("node"))
    known = nodes.select("project", F.col("path").alias("other"), "node")
    shared = (
        nodes.join(children, ["project", "node"])
        .where("other <> path")
        .join(known, ["project", "other", "node"], "left_semi")
        .select("project", at("node").alias("src"), F.concat("other", F.lit("/"), "node").alias("dst"), F.lit("shared").alias("kind"))
    )
    return drawn.unionByName(inside).unionByName(shared)


def network_degrees(network: DataFrame) -> DataFrame:
    """Connections of each node; shared edges do not count."""
    ends = network.where("kind <> 'shared'").select("project", F.explode(F.array("src", "dst")).alias("node"))
    return count_rows(ends, "project", "node", name="connections")


# ---- links -----------------------------------------------------------------------------


def link_checks(links: DataFrame) -> DataFrame:
    """Valid-url flag and the link type that is stored."""
    url = F.col("url")
    http = url.startswith("http://") | url.startswith("https://")
    valid = http | (~url.startswith("/") & ~url.contains("://"))
    known = F.when(F.col("type").isin("local", "external", "source"), F.col("type")).otherwise("external")
    kind = F.when((known == "external") & ~url.startswith("http"), "local").otherwise(known)
    return links.select(*KEYS, "url", valid.alias("valid"), kind.alias("type"))


# ---- edits ------------------------------------------------------------------------------


def update_tags(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply tag edits (project, path, action, tags): add, remove, set or clear; one edit per element."""
    new = F.filter(F.transform(F.col("edit_tags"), trimmed), lambda t: t != "")
    out = (
        F.when(F.col("action") == "add", F.array_union("tags", new))
        .when(F.col("action") == "remove", F.filter("tags", lambda t: ~F.array_contains(F.transform("edit_tags", trimmed), t)))
        .when(F.col("action") == "set", new)
        .when(F.col("action") == "clear", F.array().cast("array<string>"))
        .otherwise(F.col("tags"))
    )
    joined = elements.join(edits.select(*KEYS, "action", F.col("tags").alias("edit_tags")), KEYS, "left")
    return joined.withColumn("tags", out).drop("action", "edit_tags")


def update_links(links: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply link edits (project, path, action add|remove, url, type); a url stays unique per element."""
    keys = [*KEYS, "url"]
    kept = links.join(edits.where("action = 'remove'").select(*keys), keys, "left_anti")
    added = edits.where("action = 'add'").select(*keys, "type").dropDuplicates(keys)
    fresh = added.join(kept.select(*keys), keys, "left_anti")
    return kept.select(*keys, "type").unionByName(fresh)


def update_flows(flows: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply flow edits (project, path, action set|remove, name, description, steps), keyed by name."""
    keys = [*KEYS, "name"]
    kept = flows.join(edits.select(*keys), keys, "left_anti")
    put = edits.where("action = 'set'").where(F.size("steps") > 0).select(*keys, "description", "steps")
    return kept.select(*keys, "description", "steps").unionByName(put)


def merge_snapshots(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target rows plus the source rows whose (project, path, field) the target lacks; the target wins."""
    keys = [*KEYS, "field"]
    fresh = source.join(target.select(*keys), keys, "left_anti")
    return target.withColumn("origin", F.lit("target")).unionByName(fresh.withColumn("origin", F.lit("source")))


def merge_counts(target: DataFrame, source: DataFrame) -> DataFrame:
    """Elements that gain something and source fields skipped, per project."""
    keys = [*KEYS, "field"]
    known = target.select(*keys, F.lit(1).alias("there"))
    tagged = source.select(*keys).join(known, keys, "left").groupBy(*KEYS).agg(
        F.count("there").alias("skipped"), F.count_if(F.col("there").isNull()).alias("fresh")
    )
    return tagged.groupBy("project").agg(
        F.count_if(F.col("fresh") > 0).alias("copied"), F.sum("skipped").alias("skipped")
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, modified and removed paths between two snapshots (project, path, content)."""
    digest = lambda df, name: df.select(*KEYS, F.sha2("content", 256).alias(name))
    both = digest(old, "a").join(digest(new, "b"), KEYS, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select(*KEYS, change.alias("change")).where("change IS NOT NULL")
