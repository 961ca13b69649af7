"""Reading source trees, documentation trees and change lists."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.functions.paths import ancestors_of, base_of, dir_of, glob_to_regex, trimmed
from arborist.functions.rules import DIAGRAM_FILES, FIELD_FILES, GENERATED_FILES, IGNORED_DIRS, SUPPORTED_EXTENSIONS
from arborist.sources import tree

META_SCHEMA = (
    "project STRING, path STRING, created TIMESTAMP, updated TIMESTAMP, update_count INT, last_field STRING,"
    " git_commit STRING, git_branch STRING, kind STRING, title STRING, children ARRAY<STRING>, tags ARRAY<STRING>,"
    " diagram_format STRING, source_files ARRAY<STRING>, source_globs ARRAY<STRING>,"
    " scan_generation STRUCT<mode: STRING, git_commit: STRING, at: TIMESTAMP>,"
    " diagram_history ARRAY<STRUCT<diagram: STRING, at: TIMESTAMP, commit: STRING>>,"
    " change_log ARRAY<STRUCT<field: STRING, at: TIMESTAMP, commit: STRING>>,"
    " links ARRAY<STRUCT<url: STRING, type: STRING, label: STRING, added: TIMESTAMP>>"
)
FLOW_SCHEMA = (
    "project STRING, path STRING, name STRING, description STRING, steps ARRAY<STRUCT<node: STRING, edge: STRING>>"
)


def scan_corpus(
    spark: SparkSession, root: str, extensions: Sequence[str] | None = tuple(SUPPORTED_EXTENSIONS), content: bool = True
) -> DataFrame:
    """Files below `root`, whose first folder level is the project: (project, path, content, size, mtime).

    Without `content` the tree is listed and no file is read.  Bytes that are no UTF-8 become replacement characters.
    """
    files = tree.register(spark).read.format(tree.FILES).option("content", str(content).lower())
    return (files if extensions is None else files.option("suffixes", json.dumps(list(extensions)))).load(root)


def ignore_rules(ignore_files: DataFrame) -> DataFrame:
    """(project, negations, rooted, free): ignore files (project, content) as arrays of expressions."""
    lines = F.filter(F.transform(F.split("content", "\n"), trimmed), lambda x: (x != "") & ~x.startswith("#"))
    plain = F.filter(lines, lambda x: ~x.startswith("!"))
    rx = lambda c: glob_to_regex(c, braces=False)
    bare = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    return ignore_files.select(
        "project",
        F.transform(F.filter(lines, lambda x: x.startswith("!")), lambda x: rx(F.regexp_replace(x, "^!", ""))).alias("negations"),
        F.transform(F.filter(plain, lambda x: x.startswith("/")), lambda x: rx(bare(x))).alias("rooted"),
        F.transform(F.filter(plain, lambda x: ~x.startswith("/")), lambda x: rx(bare(x))).alias("free"),
    )


def apply_ignore(
    files: DataFrame, ignore_files: DataFrame | None = None, builtin_dirs: bool = True, generated: bool = True
) -> DataFrame:
    """Files left after the project's ignore rules, dot names, built-in folders and generated files.

    A file goes when it or any folder above it is ignored.  A project's rules
    come from one ignore file, so they ride along as one row per project and
    are tested inside the file's row; no file-by-rule pairs are made.
    """
    base_cols = files.columns
    prefixes = F.concat(ancestors_of(F.col("path")), F.array("path"))
    name = base_of
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".") & (p != "."))
    out = files.where(~hidden)
    if builtin_dirs:
        out = out.where(~F.exists(ancestors_of(F.col("path")), lambda p: name(p).isin(*IGNORED_DIRS)))
    if generated:
        out = out.where(~F.exists(prefixes, lambda p: p.rlike("|".join(GENERATED_FILES))))
    if ignore_files is None:
        return out
    joined = out.join(ignore_rules(ignore_files), "project", "left")

    def matches(p: Column, regexes: str) -> Column:
        return F.exists(F.col(regexes), lambda r: F.regexp_like(p, r))

    def ignored(p: Column) -> Column:
        anywhere = F.exists(F.concat(F.array(p), F.split(p, "/")), lambda q: matches(q, "free"))
        return ~matches(p, "negations") & (matches(p, "rooted") | anywhere)

    return joined.where(F.col("free").isNull() | ~F.exists(prefixes, ignored)).select(*base_cols)


def load_elements(corpus: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Documentation files -> `fields(project, path, field, text, format)`.

    A diagram may exist in several files: the format recorded for the element
    (project, path, diagram_format) wins, then file priority.
    """
    table = {**FIELD_FILES, **{f: "diagram" for f, _ in DIAGRAM_FILES}}
    name = base_of(F.col("path"))
    pick = lambda m: F.try_element_at(F.create_map(*[F.lit(x) for kv in m for x in kv]), name)
    rows = (
        corpus.where(name.isin(*table) & F.col("path").contains("/") & F.col("content").rlike(r"\S"))
        .where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".")))
        .select(
            "project",
            dir_of(F.col("path")).alias("path"),
            pick(table.items()).alias("field"),
            F.col("content").alias("text"),
            pick(DIAGRAM_FILES).alias("format"),
            pick([(f, i) for i, (f, _) in enumerate(DIAGRAM_FILES)]).alias("priority"),
        )
    )
    text_fields = rows.where("field <> 'diagram'").drop("priority")
    diagrams = rows.where("field = 'diagram'")
    if formats is not None:
        diagrams = diagrams.join(formats.select("project", "path", "diagram_format"), ["project", "path"], "left")
    else:
        diagrams = diagrams.withColumn("diagram_format", F.lit(None).cast("string"))
    rank = F.struct(F.when(F.col("format") == F.col("diagram_format"), 0).otherwise(1).alias("p"), F.col("priority"))
    best = diagrams.groupBy("project", "path").agg(F.min_by(F.struct("text", "format"), rank).alias("d"))
    chosen = best.select("project", "path", F.lit("diagram").alias("field"), "d.text", "d.format")
    return text_fields.unionByName(chosen)


def load_meta(spark: SparkSession, path: str, schema: str = META_SCHEMA, fmt: str = "json") -> DataFrame:
    """Element metadata or flows with an explicit schema, never inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_change_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_change_log(lines: DataFrame) -> DataFrame:
    """Change-list lines -> (path, status), keeping the other columns.

    Understands name-status lines (tab separated; a rename keeps the new path)
    and short status lines (two letters, a blank, the path).  Unknown codes
    mean modified.
    """
    keep = [c for c in lines.columns if c != "line"]
    parts = F.split("line", "\t")
    code = F.get(parts, F.lit(0))
    tabbed = F.col("line").contains("\t")
    renamed = code.startswith("R")
    diff_path = F.when(renamed, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    diff_status = (
        F.when(renamed, "renamed").when(code == "A", "added").when(code == "D", "deleted").otherwise("modified")
    )
    xy = F.regexp_extract("line", r"^(.{2}) (.+)$", 1)
    rest = F.regexp_extract("line", r"^(.{2}) (.+)$", 2)
    short_path = F.when(
        xy.contains("R") & rest.contains("->"), trimmed(F.substring_index(rest, "->", -1))
    ).otherwise(rest)
    short_status = (
        F.when(xy == "??", "untracked")
        .when(xy.contains("M"), "modified")
        .when(xy.contains("A"), "added")
        .when(xy.contains("D"), "deleted")
        .otherwise("modified")
    )
    path = F.when(tabbed, diff_path).otherwise(short_path)
    return lines.select(
        *keep,
        F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "").alias("path"),
        F.when(tabbed, diff_status).otherwise(short_status).alias("status"),
    ).where("path IS NOT NULL AND path <> ''")


