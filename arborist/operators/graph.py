"""Import graph: building it, and every one-pass question about it.

`edges(project, src, dst, imports)` holds one row per importing/imported pair,
`nodes(project, file)` one row per analysed file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.functions.common import count_rows, half_up, half_up2, top_n
from arborist.functions.paths import base_of, classify_layer, dir_of, language_of, parent_of, stem_of
from arborist.functions.rules import IMPORT_EXTENSIONS, SUMMARY_LAYERS, SUPPORTED_EXTENSIONS, VIOLATION_LAYERS

Layers = Sequence[tuple[str, Sequence[str]]]


# ---- building -------------------------------------------------------------


def import_targets(files: DataFrame) -> DataFrame:
    """(project, stem) -> file an import of that stem means.

    An import tries its stem, then stem/index, then stem plus each known
    extension, first as a file, then as a module (a file without its extension;
    index and main also stand for their folder).  Turning the table round, each
    file lists the stems that reach it with their rank, so imports need one
    equi-join instead of twenty candidates each.
    """
    file = F.col("path")
    stem = stem_of(file)
    modules = F.when(base_of(stem).isin("index", "main") & stem.contains("/"), F.array(stem, parent_of(stem))).otherwise(F.array(stem))
    ranks = F.create_map(*[F.lit(x) for i, e in enumerate(SUPPORTED_EXTENSIONS) for x in (e, i + 2)])

    def options(kind: int):
        """What reaches a file by one of its keys, a file (0) or a module (1), with the rank of that step."""

        def of(key: Column) -> Column:
            ext_rank = F.try_element_at(ranks, F.regexp_extract(key, r"(\.[^./]*)$", 1))
            option = lambda s, step: F.struct(s.alias("stem"), (step * 2 + kind).alias("rank"))
            return F.array(
                option(key, F.lit(0)),
                option(F.when(key.endswith("/index"), F.regexp_replace(key, "/index$", "")), F.lit(1)),
                option(F.when(ext_rank.isNotNull(), F.regexp_replace(key, r"\.[^./]*$", "")), ext_rank),
            )

        return of

    reached = F.flatten(F.concat(F.transform(F.array(file), options(0)), F.transform(modules, options(1))))
    best = F.filter(reached, lambda o: o["stem"].isNotNull())
    # a stem is the beginning of its file, so what follows it is enough; files that reach it with one rank do so by one module, whose last file counts
    ranked = files.select("project", file.alias("file"), F.inline(best)).select(
        "project", "stem", F.struct((-F.col("rank")).alias("rank"), F.expr("substring(file, length(stem) + 1)").alias("rest")).alias("way")
    )
    best_way = ranked.groupBy("project", "stem").agg(F.max("way").alias("way"))
    return best_way.select("project", "stem", F.concat("stem", "way.rest").alias("dst"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative imports -> `edges`, one row per pair, specifiers gathered and sorted."""
    resolved = F.coalesce("resolved", "source")
    ext = F.regexp_extract(resolved, r"(\.[^./]*)$", 1)
    stem = F.when(ext.isin(*IMPORT_EXTENSIONS), F.regexp_replace(resolved, r"\.[^./]*$", "")).otherwise(resolved)
    wanted = imports.where(F.col("source").startswith(".")).select(
        "project", F.col("file").alias("src"), stem.alias("stem"), "specifiers"
    )
    return (
        wanted.join(import_targets(files), ["project", "stem"])
        .where(F.col("src") != F.col("dst"))
        .groupBy("project", "src", "dst")
        .agg(F.sort_array(F.flatten(F.collect_list("specifiers"))).alias("imports"))
    )


def graph_nodes(files: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """`nodes(project, file, n_exports)`."""
    nodes = files.select("project", F.col("path").alias("file")).distinct()
    if exports is None:
        return nodes
    return nodes.join(count_rows(exports, "project", "file", name="n_exports"), ["project", "file"], "left").fillna(
        0, ["n_exports"]
    )


# ---- degrees --------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """Fan-in and fan-out of every connected file, one shuffle."""
    ends = edges.select(
        "project",
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.col("src").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        ).alias("e"),
    )
    return ends.groupBy("project", F.col("e.file").alias("file")).agg(
        F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out")
    )


def hotspots(edges: DataFrame, n: int = 20) -> DataFrame:
    """Most imported files of each project.

    Only importers are counted for all files, what they import for the chosen
    ones; a caller that doesn't take `fan_out` doesn't pay for it.
    """
    ranked = count_rows(edges.withColumnRenamed("dst", "file"), "project", "file", name="fan_in")
    top = top_n(ranked, ["project"], [F.desc("fan_in"), F.asc("file")], n)
    fan_out = count_rows(edges.withColumnRenamed("src", "file"), "project", "file", name="fan_out")
    return top.join(fan_out, ["project", "file"], "left").fillna(0, ["fan_out"])


def hotspot_importers(edges: DataFrame, n: int = 20) -> DataFrame:
    """The importers of each hotspot, one row per importer."""
    hot = hotspots(edges, n).select("project", F.col("file").alias("dst"))
    return edges.select("project", "src", "dst").join(hot, ["project", "dst"]).select(
        "project", F.col("dst").alias("file"), F.col("src").alias("importer")
    )


def god_nodes(edges: DataFrame, n: int = 10) -> DataFrame:
    """Most connected files; a bridge has many edges both ways, a hub many incoming."""
    role = (
        F.when((F.col("fan_in") > 5) & (F.col("fan_out") > 5), "bridge").when(F.col("fan_in") > 5, "hub").otherwise("normal")
    )
    full = degrees(edges).withColumn("total_edges", F.col("fan_in") + F.col("fan_out")).withColumn("role", role)
    return top_n(full, ["project"], [F.desc("total_edges"), F.asc("file")], n)


# ---- modules --------------------------------------------------------------


def _modules(nodes: DataFrame) -> DataFrame:
    return (
        nodes.groupBy("project", dir_of(F.col("file")).alias("dir"))
        .agg(F.count(F.lit(1)).alias("n_files"))
        .where("n_files >= 2")
    )


def module_entry_points(nodes: DataFrame, exports: DataFrame) -> DataFrame:
    """Files of a module that export a function or class, one row each."""
    public = exports.where(F.col("kind").isin("function", "class")).select("project", "file").distinct()
    return (
        public.withColumn("dir", dir_of(F.col("file")))
        .join(_modules(nodes), ["project", "dir"], "left_semi")
        .select("project", "dir", "file")
    )


def module_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct files outside a module that its files import."""
    out = edges.select("project", dir_of(F.col("src")).alias("dir"), "dst").where(dir_of(F.col("dst")) != F.col("dir"))
    return out.distinct().join(_modules(nodes), ["project", "dir"], "left_semi")


def module_boundaries(nodes: DataFrame, edges: DataFrame, exports: DataFrame) -> DataFrame:
    """Directories with at least two files: size, cohesion, entry points, dependencies.

    The lists behind the last two counts are `module_entry_points` and
    `module_dependencies`.
    """
    keys = ["project", "dir"]
    inside = dir_of(F.col("src")) == dir_of(F.col("dst"))
    flow = edges.groupBy("project", dir_of(F.col("src")).alias("dir")).agg(
        F.count_if(inside).alias("internal_edges"), F.count_if(~inside).alias("external_edges")
    )
    entries = count_rows(module_entry_points(nodes, exports), *keys, name="entry_points")
    deps = count_rows(module_dependencies(nodes, edges), *keys, name="dependencies")
    total = F.col("internal_edges") + F.col("external_edges")
    return (
        _modules(nodes)
        .join(flow, keys, "left")
        .join(entries, keys, "left")
        .join(deps, keys, "left")
        .fillna(0, ["internal_edges", "external_edges", "entry_points", "dependencies"])
        .withColumn("cohesion", half_up2(F.when(total > 0, F.col("internal_edges") / total).otherwise(0.0)))
        .withColumn("name", base_of(F.col("dir")))
    )


# ---- exports and names ----------------------------------------------------


def dead_exports(exports: DataFrame, edges: DataFrame) -> DataFrame:
    """Exports no edge into their file names."""
    used = edges.select("project", F.col("dst").alias("file"), F.explode("imports").alias("name")).distinct()
    return exports.where("name <> 'default'").join(used, ["project", "file", "name"], "left_anti")


def public_api(definitions: DataFrame) -> DataFrame:
    """Exported definitions, one row each, with the size of their kind."""
    exported = definitions.where("exported")
    kinds = count_rows(exported, "project", "kind", name="kind_count")
    return exported.select("project", "kind", "name", "file").join(kinds, ["project", "kind"])


def complex_definitions(definitions: DataFrame, threshold: int = 50) -> DataFrame:
    span = F.col("end_line") - F.col("line")
    return definitions.withColumn("line_span", span).where(span >= threshold).select(
        "project", "file", "name", "kind", "line_span", "line", "end_line"
    )


def importers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Files importing each target (project, file)."""
    return edges.join(targets.select("project", F.col("file").alias("dst")), ["project", "dst"], "left_semi").select(
        "project", F.col("dst").alias("file"), F.col("src").alias("importer")
    )


def imports_of(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Files each source (project, file) imports, with the names used."""
    return edges.join(sources.select("project", F.col("file").alias("src")), ["project", "src"], "left_semi").select(
        "project", F.col("src").alias("file"), F.col("dst").alias("imported"), F.array_join("imports", ",").alias("names")
    )


def resolve_names(terms: Sequence[str], nodes: DataFrame) -> DataFrame:
    """Bind free-text terms to one file per project.

    Exact path, then path without extension, then base name, then substring;
    within a rank the least path.  Terms come from the caller, so each file
    tests a literal list and emits only its hits.
    """
    low = F.lower("file")
    stem = F.lower(stem_of(F.col("file")))
    base = F.lower(stem_of(base_of(F.col("file"))))

    def rank(t: str) -> Column:
        return F.when(low == t, 0).when(stem == t, 1).when(base == t, 2).when(low.contains(t), 3)

    hits = F.filter(
        F.array(*[F.struct(F.lit(t).alias("term"), rank(t.lower()).alias("rank")) for t in terms]),
        lambda h: h["rank"].isNotNull(),
    )
    return (
        nodes.select("project", "file", F.inline(hits))
        .groupBy("project", "term")
        .agg(F.min(F.struct("rank", "file")).alias("best"))
        .select("project", "term", F.col("best.file").alias("file"), F.col("best.rank").alias("rank"))
    )


# ---- layers ---------------------------------------------------------------


def classify_layers(nodes: DataFrame, rules: Layers = SUMMARY_LAYERS) -> DataFrame:
    return nodes.select("project", "file", classify_layer(F.col("file"), rules).alias("layer"))


def layer_summary(nodes: DataFrame, rules: Layers = SUMMARY_LAYERS) -> DataFrame:
    """Files per layer in rule order, empty layers included, plus unclassified files."""
    names = [name for name, _ in rules] + ["unclassified"]
    layer = F.coalesce(classify_layer(F.col("file"), rules), F.lit("unclassified"))
    counts = nodes.groupBy("project").agg(*[F.count_if(layer == n).alias(n) for n in names])
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("position"), F.lit(n).alias("layer"), F.col(n).alias("files"))
            for i, n in enumerate(names)
        ]
    )
    return counts.select("project", F.inline(rows)).where("layer <> 'unclassified' OR files > 0")


def layer_violations(edges: DataFrame, rules: Layers = VIOLATION_LAYERS) -> DataFrame:
    """Edges that skip at least one layer on the way down."""
    names = F.array(*[F.lit(n) for n, _ in rules])
    with_layers = edges.select(
        "project",
        "src",
        "dst",
        classify_layer(F.col("src"), rules).alias("src_layer"),
        classify_layer(F.col("dst"), rules).alias("dst_layer"),
    )
    i = F.array_position(names, F.col("src_layer"))
    j = F.array_position(names, F.col("dst_layer"))
    skipped = F.slice(names, (i + 1).cast("int"), (j - i - 1).cast("int"))
    return with_layers.where(j > i + 1).select(
        "project",
        "src",
        "dst",
        "src_layer",
        "dst_layer",
        F.array_join(skipped, ",").alias("skipped"),
        (j - i - 1).cast("int").alias("n_skipped"),
    )


# ---- languages and score --------------------------------------------------


def language_stats(source_files: DataFrame) -> DataFrame:
    """Files, lines, bytes and share of bytes per language."""
    per = (
        source_files.select(
            "project",
            language_of(F.col("path")).alias("language"),
            (F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit(""))) + 1).alias("lines"),
            F.octet_length("content").cast("bigint").alias("bytes"),
        )
        .where("language IS NOT NULL")
        .groupBy("project", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    )
    total = per.groupBy("project").agg(F.sum("bytes").alias("total"))
    share = F.when(F.col("total") > 0, F.floor(F.col("bytes") / F.col("total") * 10000 + 0.5) / 100).otherwise(0.0)
    return per.join(total, "project").select("project", "language", "files", "lines", "bytes", share.alias("percentage"))


def run_counts(source_files: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Total, analysed, skipped and failed files of each project."""
    base = source_files.select("project", "path", language_of(F.col("path")).isNotNull().alias("known"))
    if errors is not None:
        failed = errors.select("project", F.col("file").alias("path"), F.lit(True).alias("failed")).distinct()
        base = base.join(failed, ["project", "path"], "left")
    else:
        base = base.withColumn("failed", F.lit(None).cast("boolean"))
    bad = F.coalesce("failed", F.lit(False))
    return base.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("known") & ~bad).alias("analyzed_files"),
        F.count_if(~F.col("known")).alias("skipped_files"),
        F.count_if(bad).alias("error_files"),
    )


def fitness(
    nodes: DataFrame,
    edges: DataFrame,
    cycles_found: DataFrame,
    undocumented: DataFrame | None = None,
    layers: Layers = VIOLATION_LAYERS,
) -> DataFrame:
    """Architectural fitness of each project, five parts of twenty points.

    `cycles_found` has one row per cycle, `undocumented` one per missing
    dependency; every input is first reduced to one row per project.
    """
    inside = dir_of(F.col("src")) == dir_of(F.col("dst"))
    flow = edges.groupBy("project", dir_of(F.col("src")).alias("dir")).agg(
        F.count_if(inside).alias("i"), F.count(F.lit(1)).alias("t")
    )
    modules = (
        _modules(nodes)
        .join(flow, ["project", "dir"], "left")
        .withColumn("cohesion100", half_up(F.coalesce(F.col("i") / F.col("t"), F.lit(0.0)) * 100))
        .groupBy("project")
        .agg((F.sum("cohesion100") / (F.count(F.lit(1)) * 100)).alias("avg_cohesion"))
    )
    fan = count_rows(edges, "project", "dst", name="fan_in").groupBy("project").agg(F.max("fan_in").alias("max_fan_in"))
    viol = count_rows(layer_violations(edges, layers), "project", name="layer_violation_count")
    cyc = count_rows(cycles_found, "project", name="cycles_found")
    base = nodes.select("project").distinct()
    joined = base
    for part in (modules, fan, viol, cyc):
        joined = joined.join(part, "project", "left")
    if undocumented is not None:
        joined = joined.join(count_rows(undocumented, "project", name="undocumented_deps"), "project", "left")
    else:
        joined = joined.withColumn("undocumented_deps", F.lit(0).cast("bigint"))
    joined = joined.fillna(1.0, ["avg_cohesion"]).fillna(
        0, ["max_fan_in", "layer_violation_count", "cycles_found", "undocumented_deps"]
    )
    zero = F.lit(0).cast("bigint")
    parts = joined.select(
        "project",
        F.greatest(zero, 20 - 2 * F.col("cycles_found")).alias("circular_deps"),
        half_up(F.col("avg_cohesion") * 20).alias("cohesion"),
        F.greatest(zero, 20 - 2 * F.greatest(zero, F.col("max_fan_in") - 5)).alias("coupling"),
        F.greatest(zero, 20 - F.col("layer_violation_count")).alias("layer_purity"),
        F.greatest(zero, 20 - F.col("undocumented_deps")).alias("doc_accuracy"),
        "cycles_found",
        half_up(F.col("avg_cohesion") * 100).alias("avg_cohesion_pct"),
        "max_fan_in",
        "layer_violation_count",
        "undocumented_deps",
    )
    total = (
        F.col("circular_deps") + F.col("cohesion") + F.col("coupling") + F.col("layer_purity") + F.col("doc_accuracy")
    )
    return parts.withColumn("overall", F.least(F.lit(100).cast("bigint"), F.greatest(zero, total)))
