"""Queries that write trees, mirrors, run logs and fingerprints to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborist.operators import graph as g
from arborist.operators import tracking as tr
from arborist.plans.code import SQL_MODULES
from arborist.plans.registry import Registry
from arborist.plans.tracking import SQL_PRINTS
from arborist.session import scratch
from arborist.sources import corpus, sinks, tree

R = Registry()
KEYS = ["project", "path"]


def _tree(d) -> str:
    """Root of an element tree that holds the fields."""
    spark = tree.register(d.spark)
    root = scratch(spark, "tree")
    d["fields"].select(*KEYS, "field", "text").write.format(tree.NAME).mode("append").save(root)
    return root


R.add(
    "tree_round_trip",
    "fields",
    lambda d: d.spark.read.format(tree.NAME).load(_tree(d)),
    "SELECT project, path, field, text FROM fields",
)
R.add(
    "tree_of_a_field",
    "fields",
    lambda d: d.spark.read.format(tree.NAME).option("fields", '["note"]').load(_tree(d)),
    "SELECT project, path, field, text FROM fields WHERE field = 'note'",
)
R.add(
    "scanned_elements",
    "fields",
    lambda d: corpus.load_elements(corpus.scan_corpus(d.spark, _tree(d), None)),
    """SELECT project, path, field, text, CASE field WHEN 'diagram' THEN 'flowchart' END AS format FROM fields WHERE regexp_matches(text, '\\S')""",
)


def _mirror(d):
    path = scratch(d.spark, "mirror")
    kinds = d["elements"].select(*KEYS, F.length("path").alias("size"))
    sinks.snapshot_elements(kinds, path)
    # a later state of some projects: half of their elements have gone
    sinks.snapshot_elements(kinds.where("project LIKE 's1%' AND size % 2 = 0").withColumn("size", -F.col("size")), path)
    return d.spark.read.schema("path STRING, size INT, project STRING").parquet(path).select("project", "path", "size")


R.add(
    "snapshot_mirror",
    "elements",
    _mirror,
    """, kinds AS (SELECT project, path, CAST(length(path) AS INTEGER) AS size FROM elements)
    , later AS (SELECT project, path, -size AS size FROM kinds WHERE project LIKE 's1%' AND size % 2 = 0)
    SELECT * FROM later UNION ALL SELECT * FROM kinds k WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.project = k.project)""",
)


def _runs(d):
    path = scratch(d.spark, "runs")
    modules = g.module_boundaries(d["node_files"], d["edges"], d["exports"])
    for at, files in (("2024-01-01 00:00:00", d["node_files"].where("file LIKE '%.ts'")), ("2024-02-01 00:00:00", d["node_files"])):
        sinks.append_run(sinks.run_summary(files, d["edges"], modules, at), path)
    log = d.spark.read.schema("project STRING, files LONG, edges LONG, modules LONG, languages MAP<STRING, LONG>, at TIMESTAMP").parquet(path)
    spoken = F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return log.select("project", "files", "edges", "modules", spoken.alias("languages"), F.date_format("at", "yyyy-MM-dd").alias("day"))


R.add(
    "run_log",
    "edges node_files exports",
    _runs,
    SQL_MODULES + """, e AS (SELECT project, count(*) AS edges FROM edges GROUP BY ALL), m AS (SELECT project, count(*) AS modules FROM modules GROUP BY ALL)
    , runs AS (SELECT project, file, day FROM node_files, (VALUES ('2024-01-01'), ('2024-02-01')) v(day) WHERE day = '2024-02-01' OR file LIKE '%.ts')
    , l AS (SELECT project, day, CASE WHEN file LIKE '%.js' THEN 'javascript' ELSE 'typescript' END AS language, count(*) AS n FROM runs GROUP BY ALL)
    SELECT r.project, r.files, coalesce(edges, 0) AS edges, coalesce(modules, 0) AS modules,
      (SELECT string_agg(language || ':' || n, ',' ORDER BY language) FROM l WHERE l.project = r.project AND l.day = r.day) AS languages, r.day
    FROM (SELECT project, day, count(*) AS files FROM runs GROUP BY ALL) r LEFT JOIN e ON e.project = r.project LEFT JOIN m ON m.project = r.project""",
)


def _prints(d):
    path = scratch(d.spark, "fingerprints")
    sinks.save_fingerprints(tr.file_fingerprints(d["old_definitions"]), path)
    sinks.save_fingerprints(tr.file_fingerprints(d["new_definitions"]), path)
    return sinks.load_fingerprints(d.spark, path).select("project", "file", "hash", "n_items")


R.add(
    "saved_fingerprints",
    "old_definitions new_definitions",
    _prints,
    SQL_PRINTS + "SELECT project, file, h AS hash, n AS n_items FROM fpn",
)


def _meta(d):
    path = scratch(d.spark, "meta")
    wanted = d["meta"].select(*KEYS, "tags", "source_files", "source_globs", F.struct(F.lit("full").alias("mode"), "git_commit").alias("scan_generation"))
    wanted.write.json(path)
    back = corpus.load_meta(d.spark, path)
    joined = [F.array_join(F.coalesce(c, F.array()), ",").alias(c) for c in ("tags", "source_files", "source_globs")]
    return back.select(*KEYS, *joined, F.col("scan_generation.git_commit").alias("git_commit"))


R.add(
    "loaded_meta",
    "meta",
    _meta,
    """SELECT project, path, coalesce(array_to_string(tags, ','), '') AS tags, coalesce(array_to_string(source_files, ','), '') AS source_files,
       coalesce(array_to_string(source_globs, ','), '') AS source_globs, git_commit FROM meta""",
)
