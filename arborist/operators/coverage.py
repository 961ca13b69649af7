"""Which documentation element covers which source file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.functions.common import count_rows, half_up, top_n
from arborist.functions.paths import (
    base_of,
    dir_of,
    glob_extension,
    glob_prefix,
    glob_to_regex,
    normalize_path,
    path_glob_keys,
    stem_of,
)


def glob_matches(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """Matching pairs of `paths(project, file)` and `globs(project, glob, ...)`.

    A glob fixes its leading directories and often its extension.  Both sides
    carry that (prefix, extension) as a key, so a file only meets globs that
    agree with it on everything literal.  The globs of a key are gathered into
    one row, and the wild part is tested inside the file's row: a key that all
    files share costs each of them one row, and Spark can split its files.  A
    bare `dir/**` needs no expression at all.
    """
    keyed = globs.select(
        *[F.col(c) for c in globs.columns],
        glob_prefix(F.col("glob")).alias("g_prefix"),
        glob_extension(F.col("glob")).alias("g_ext"),
        glob_to_regex(F.col("glob")).alias("g_regex"),
    ).withColumn("g_all", F.col("glob") == F.concat("g_prefix", F.lit("**")))
    files = paths.select("project", "file").distinct().select("project", "file", F.inline(path_glob_keys(F.col("file"))))
    gathered = keyed.groupBy("project", "g_prefix", "g_ext").agg(
        F.collect_list(F.struct("g_all", "g_regex", *[F.col(c) for c in globs.columns if c != "project"])).alias("g_list")
    )
    hits = F.expr("filter(g_list, g -> g.g_all OR file RLIKE g.g_regex)")
    met = files.join(gathered, ["project", "g_prefix", "g_ext"]).select("project", "file", F.inline(hits))
    return met.select("file", *globs.columns)


def _rank(method: int, depth: Column | None = None) -> Column:
    """Order of the ways a file finds its element: by method, then the deepest segment."""
    return F.struct(F.lit(method).alias("method"), (F.lit(0) if depth is None else depth).alias("depth")).alias("rank")


def _names(elements: DataFrame) -> DataFrame:
    return elements.groupBy("project", base_of(F.col("path")).alias("name")).agg(
        F.min("path").alias("element"), F.count(F.lit(1)).alias("candidates")
    )


def coverage_map(files: DataFrame, elements: DataFrame) -> DataFrame:
    """(project, path, element, method): exact source file, then glob, then name of a path segment.

    A file tracked twice belongs to the last element; of several globs the
    first element wins; of several segments the deepest, then the first element.
    """
    inventory = files.select("project", F.col("path").alias("file")).distinct()
    exact = (
        elements.select("project", "path", F.explode("source_files").alias("file"))
        .groupBy("project", F.regexp_replace("file", r"\\", "/").alias("file"))
        .agg(F.max("path").alias("element"))
        .select("project", "file", "element", F.lit("source_files").alias("method"), _rank(0))
    )
    globs = elements.select("project", "path", F.explode("source_globs").alias("glob")).groupBy("project", "glob").agg(
        F.min("path").alias("element")
    )
    by_glob = glob_matches(inventory, globs).select(
        "project", "file", "element", F.lit("source_globs").alias("method"), _rank(1)
    )
    segments = inventory.select("project", "file", F.posexplode(F.split("file", "/")).alias("pos", "segment"))
    by_name = (
        segments.withColumn("name", stem_of(F.col("segment")))
        .join(_names(elements).select("project", "name", "element"), ["project", "name"])
        .select(
            "project", "file", "element", F.lit("heuristic").alias("method"), _rank(2, -F.col("pos"))
        )
    )
    best = (
        exact.unionByName(by_glob)
        .unionByName(by_name)
        .groupBy("project", "file")
        .agg(F.min(F.struct("rank", "element", "method")).alias("m"))
    )
    return inventory.join(best, ["project", "file"], "left").select(
        "project", F.col("file").alias("path"), "m.element", "m.method"
    )


def ambiguous_names(elements: DataFrame) -> DataFrame:
    """Element names the name match cannot tell apart, and the element it uses."""
    return _names(elements).where("candidates > 1")


def uncovered_files(coverage: DataFrame) -> DataFrame:
    return coverage.where("element IS NULL").select("project", "path")


def coverage_stats(coverage: DataFrame, elements: DataFrame) -> DataFrame:
    """Totals, percentage, matched and orphaned elements, and tracking methods, per project."""
    c = F.col
    files = coverage.groupBy("project").agg(
        F.count(F.lit(1)).alias("source_files"), F.count("element").alias("covered_files")
    )
    used = coverage.where("element IS NOT NULL").select("project", F.col("element").alias("path"), F.lit(True).alias("used")).distinct()
    tracked = (
        elements.select(
            "project", "path", (F.size("source_files") > 0).alias("by_file"), (F.size("source_globs") > 0).alias("by_glob")
        )
        .join(used, ["project", "path"], "left")
        .groupBy("project")
        .agg(
            F.count(F.lit(1)).alias("elements"),
            F.count("used").alias("matched_elements"),
            F.count_if(c("used").isNull()).alias("orphaned_elements"),
            F.count_if(c("by_file")).alias("track_source_files"),
            F.count_if(~c("by_file") & c("by_glob")).alias("track_source_globs"),
            F.count_if(~c("by_file") & ~c("by_glob")).alias("track_heuristic"),
        )
    )
    joined = files.join(tracked, "project", "left").fillna(0)
    return joined.withColumn("uncovered_files", c("source_files") - c("covered_files")).withColumn(
        "coverage_pct", half_up(c("covered_files") / c("source_files") * 100)
    )


def top_uncovered_dirs(coverage: DataFrame, n: int = 5) -> DataFrame:
    dirs = count_rows(
        coverage.where("element IS NULL").select("project", dir_of(F.col("path")).alias("dir")), "project", "dir", name="files"
    )
    return top_n(dirs, ["project"], [F.desc("files"), F.asc("dir")], n)


def dominant_element(coverage: DataFrame) -> DataFrame:
    """The element covering most files of each directory; ties to the least."""
    n = count_rows(
        coverage.where("element IS NOT NULL").select("project", dir_of(F.col("path")).alias("dir"), "element"),
        "project",
        "dir",
        "element",
    )
    return n.groupBy("project", "dir").agg(F.min_by("element", F.struct((-F.col("n")).alias("n"), "element")).alias("element"))


def orphaned_elements(coverage: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements covering nothing, and why."""
    used = coverage.where("element IS NOT NULL").select("project", F.col("element").alias("path")).distinct()
    reason = (
        F.when(F.size("source_files") > 0, "source_files point to deleted/moved files")
        .when(F.size("source_globs") > 0, "source_globs match no current files")
        .otherwise("no source_files, no directory match")
    )
    return elements.join(used, ["project", "path"], "left_anti").select("project", "path", reason.alias("reason"))


def orphaned_sources(elements: DataFrame, files: DataFrame) -> DataFrame:
    """Tracked source files missing from the inventory: (project, path, file)."""
    tracked = elements.select("project", "path", F.explode("source_files").alias("file"))
    present = files.select("project", normalize_path(F.col("path")).alias("clean")).distinct()
    return tracked.withColumn("clean", normalize_path(F.col("file"))).join(present, ["project", "clean"], "left_anti").select(
        "project", "path", "file"
    )
