"""Change planning: which elements a set of file changes makes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.functions.paths import ancestors_of, normalize_path
from arborist.functions.text import definition_hash, lane_digest
from arborist.session import cut_lineage
from arborist.operators.coverage import glob_matches, orphaned_sources

KEYS = ["project", "path"]


def dedupe_changes(changes: DataFrame) -> DataFrame:
    """One status per changed path: committed before working, then first seen."""
    source = F.when(F.col("ref").isNull(), 1).otherwise(0)
    return changes.groupBy("project", "path").agg(F.min_by("status", F.struct(source.alias("s"), F.col("seq"))).alias("status"))


def union_changes(committed: DataFrame, working: DataFrame) -> DataFrame:
    """Committed and working-tree changes as one table, one row per path."""
    return dedupe_changes(committed.unionByName(working, allowMissingColumns=True))


def _baseline(elements: DataFrame, since: str | None) -> Column:
    return F.lit(since) if since is not None else F.col("git_commit")


def change_hits(elements: DataFrame, changes: DataFrame, since: str | None = None) -> DataFrame:
    """(project, path, file, reason): changed files that a tracking element owns.

    A change counts for an element when it is in the working tree (no ref) or
    recorded since the element's own baseline.  An exact path beats a glob.
    """
    el = elements.select(*KEYS, _baseline(elements, since).alias("base"), "source_files", "source_globs")
    ch = changes.select("project", "ref", F.col("path").alias("file")).distinct()
    counts = F.col("ref").isNull() | (F.col("ref") == F.col("base"))
    exact = (
        el.select(*KEYS, "base", F.explode("source_files").alias("tracked"))
        .withColumn("clean", normalize_path(F.col("tracked")))
        .join(ch.withColumn("clean", normalize_path(F.col("file"))), ["project", "clean"])
        .where(counts)
        .select(*KEYS, "file", F.lit(0).alias("rank"))
    )
    wanted = el.select(*KEYS, "base", F.explode("source_globs").alias("glob"))
    matched = glob_matches(ch.select("project", "file"), wanted.select("project", "glob").distinct())
    by_glob = (
        matched.join(wanted, ["project", "glob"])
        .join(ch, ["project", "file"])
        .where(counts)
        .select(*KEYS, "file", F.lit(1).alias("rank"))
    )
    best = exact.unionByName(by_glob).groupBy(*KEYS, "file").agg(F.min("rank").alias("rank"))
    return best.select(*KEYS, "file", F.when(F.col("rank") == 0, "source_file").otherwise("source_glob").alias("reason"))


def _change_counts(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number of changed paths: in the working tree, and committed only per baseline."""
    per_path = changes.select(*KEYS, "ref").distinct()
    working = per_path.where("ref IS NULL").select(*KEYS)
    working_n = working.groupBy("project").agg(F.count(F.lit(1)).alias("working_n"))
    only = per_path.where("ref IS NOT NULL").join(working, KEYS, "left_anti")
    committed_n = only.groupBy("project", F.col("ref").alias("base")).agg(F.count(F.lit(1)).alias("committed_n"))
    return working_n, committed_n


def plan_incremental(
    elements: DataFrame,
    changes: DataFrame,
    files: DataFrame,
    since: str | None = None,
    has_git: bool = True,
    mtime_fallback: bool = True,
) -> DataFrame:
    """Plan per element: status stale / fresh / unknown, reasons, number of matched files, ancestor.

    The files behind a stale element are `change_hits` and `orphaned_sources`;
    an element that tracks nothing is stale with the whole change set, so only
    its size is given.  Without git there are no changes, and the clock decides.
    """
    if not has_git:
        changes = changes.where(F.lit(False))
    el = elements.select(
        *KEYS,
        "git_commit",
        "updated",
        _baseline(elements, since).alias("base"),
        (F.size("source_files") + F.size("source_globs")).alias("tracked"),
    )
    hits = change_hits(elements, changes, since)
    orphans = orphaned_sources(elements, files).select(*KEYS, "file", F.lit("orphaned_source").alias("reason"))
    owned = hits.unionByName(orphans)
    facts = owned.groupBy(*KEYS).agg(
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("hit_reasons"),
        F.count_distinct("file").alias("hit_files"),
    )
    working_n, committed_n = _change_counts(changes)
    state = (
        el.join(facts, KEYS, "left")
        .join(working_n, "project", "left")
        .join(committed_n, ["project", "base"], "left")
        .fillna(0, ["working_n", "committed_n"])
    )
    if mtime_fallback:
        clock = F.lit(True) if not has_git else F.col("git_commit").isNull()
        newer = (
            elements.where(clock)
            .select(*KEYS, "updated", F.explode("source_files").alias("file"))
            .withColumn("clean", normalize_path(F.col("file")))
            .join(files.select("project", normalize_path(F.col("path")).alias("clean"), "mtime"), ["project", "clean"])
            .where("mtime > updated")
            .groupBy(*KEYS)
            .agg(F.count_distinct("clean").alias("newer_files"))
        )
        state = state.join(newer, KEYS, "left")
    else:
        state = state.withColumn("newer_files", F.lit(None).cast("bigint"))
    c = F.col
    any_change = c("working_n") + c("committed_n")
    decided = state.select(
        *KEYS,
        "tracked",
        F.when(c("tracked") == 0, F.when(any_change > 0, "stale").otherwise("open"))
        .when(c("hit_reasons").isNotNull() | c("newer_files").isNotNull(), "stale")
        .otherwise("fresh")
        .alias("status"),
        F.when(c("tracked") == 0, F.when(any_change > 0, "no_source_tracking"))
        .when(c("hit_reasons").isNotNull(), c("hit_reasons"))
        .when(c("newer_files").isNotNull(), "source_file_mtime")
        .alias("reasons"),
        F.when(c("tracked") == 0, any_change)
        .otherwise(F.coalesce("hit_files", "newer_files", F.lit(0).cast("bigint")))
        .alias("matched"),
    )
    return _inherit(decided)


def _inherit(decided: DataFrame) -> DataFrame:
    """Untracked elements take staleness from their nearest stale ancestor."""
    lineage = decided.where("status = 'open'").select(
        *KEYS, F.posexplode(ancestors_of(F.col("path"))).alias("depth", "ancestor")
    )
    stale = decided.where("status = 'stale'").select("project", F.col("path").alias("ancestor"))
    heirs = lineage.join(stale, ["project", "ancestor"], "left_semi").select(*KEYS).distinct()
    donors = stale.unionByName(heirs.select("project", F.col("path").alias("ancestor")))
    nearest = (
        lineage.join(heirs, KEYS, "left_semi")
        .join(donors, ["project", "ancestor"], "left_semi")
        .groupBy(*KEYS)
        .agg(F.max_by("ancestor", "depth").alias("inherited_from"))
    )
    got = F.col("inherited_from").isNotNull()
    return decided.join(nearest, KEYS, "left").select(
        *KEYS,
        F.when(F.col("status") != "open", F.col("status")).when(got, "stale").otherwise("unknown").alias("status"),
        F.when(got, "no_source_tracking").otherwise(F.col("reasons")).alias("reasons"),
        F.when(got, F.lit(1).cast("bigint")).otherwise(F.col("matched")).alias("matched"),
        "inherited_from",
    )


def changed_only(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of elements the plan calls stale or unknown."""
    return df.join(plan.where("status IN ('stale', 'unknown')").select(*KEYS), KEYS, "left_semi")


def explain(requested: DataFrame, plan: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Status and reasons of requested elements (project, path), 'not found' included."""
    out = requested.select(*KEYS).distinct().join(plan, KEYS, "left").withColumn("status", F.coalesce("status", F.lit("not found")))
    return out if scores is None else out.join(scores.select(*KEYS, "score"), KEYS, "left")


def changed_vs_deleted(changes: DataFrame, files: DataFrame, scope: str = "") -> DataFrame:
    """Distinct changed paths under `scope`, each existing or deleted."""
    present = files.select(*KEYS, F.lit(True).alias("present")).distinct()
    paths = changes.select(*KEYS).distinct()
    if scope:
        paths = paths.where(F.col("path").startswith(scope.rstrip("/") + "/"))
    state = F.when(F.col("present"), "existing").otherwise("deleted")
    return paths.join(present, KEYS, "left").select(*KEYS, state.alias("state"))


# ---- fingerprints ------------------------------------------------------------


def file_fingerprints(definitions: DataFrame) -> DataFrame:
    """Structural hash of each file: (project, file, hash, n_items)."""
    items = definitions.select("project", "file", F.concat_ws(":", "kind", "name", "line", "end_line").alias("item"))
    return lane_digest(items, ["project", "file"], "item").select(
        "project", "file", F.substring("digest", 1, 16).alias("hash"), "n_items"
    )


def _collapsed(definitions: DataFrame) -> DataFrame:
    """Definitions by (kind, name): overloads collapse, the last one counts."""
    mark = definition_hash(F.col("name"), F.col("kind"), F.col("line"), F.col("end_line"))
    return definitions.groupBy("project", "file", "kind", "name").agg(
        F.max_by(mark, F.struct("line", "end_line")).alias("mark")
    )


def definition_changes(prev: DataFrame, curr: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Added, removed and modified definitions of files whose fingerprint changed (`changed`, where it is known already)."""
    keys = ["project", "file", "kind", "name"]
    changed = (changed_files(prev, curr) if changed is None else changed).select("project", "file")
    a = _collapsed(prev.join(changed, ["project", "file"], "left_semi")).withColumnRenamed("mark", "a")
    b = _collapsed(curr.join(changed, ["project", "file"], "left_semi")).withColumnRenamed("mark", "b")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("change")).where("change IS NOT NULL")


def changed_files(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Files whose fingerprint differs: new, deleted or changed, with sizes."""
    a = file_fingerprints(prev).select("project", "file", F.col("hash").alias("h_old"), F.col("n_items").alias("n_old"))
    b = file_fingerprints(curr).select("project", "file", F.col("hash").alias("h_new"), F.col("n_items").alias("n_new"))
    both = a.join(b, ["project", "file"], "full_outer").where("NOT (h_old <=> h_new)")
    state = F.when(F.col("h_old").isNull(), "new").when(F.col("h_new").isNull(), "deleted").otherwise("changed")
    return both.select("project", "file", state.alias("state"), "n_old", "n_new")


def fingerprint_deltas(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Per file: added, removed, modified and unchanged definitions.  Unchanged files give no row."""
    changed = cut_lineage(changed_files(prev, curr))
    kinds = definition_changes(prev, curr, changed).groupBy("project", "file").agg(
        *[F.count_if(F.col("change") == k).alias(k) for k in ("added", "removed", "modified")]
    )
    joined = changed.join(kinds, ["project", "file"], "left").fillna(0)
    c = F.col
    new, gone = c("state") == "new", c("state") == "deleted"
    added = F.when(new, c("n_new")).otherwise(c("added"))
    removed = F.when(gone, c("n_old")).otherwise(c("removed"))
    return joined.select(
        "project",
        "file",
        added.alias("added"),
        removed.alias("removed"),
        c("modified"),
        F.when(new | gone, F.lit(0).cast("bigint")).otherwise(c("n_new") - c("added") - c("modified")).alias("unchanged"),
        (new | gone | (c("added") > 0) | (c("removed") > 0) | (c("modified") > 0)).alias("has_changes"),
    )


def deltas_to_elements(deltas: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements owning structurally changed files: (project, path, file)."""
    moved = deltas.where("has_changes").select(
        "project", F.lit(None).cast("string").alias("ref"), F.col("file").alias("path")
    )
    return change_hits(elements, moved).select(*KEYS, "file")


# ---- updates --------------------------------------------------------------------


def apply_orphan_fix(elements: DataFrame, orphans: DataFrame) -> DataFrame:
    """Drop orphaned entries from `source_files`; `removed` counts them."""
    gone = orphans.groupBy(*KEYS).agg(F.collect_set("file").alias("gone"))
    kept = F.filter("source_files", lambda f: ~F.array_contains("gone", f))
    joined = elements.join(gone, KEYS, "left").withColumn(
        "kept", F.when(F.col("gone").isNull(), F.col("source_files")).otherwise(kept)
    )
    return (
        joined.withColumn("removed", F.size("source_files") - F.size("kept"))
        .withColumn("source_files", F.col("kept"))
        .drop("gone", "kept")
    )


def update_tracking(elements: DataFrame, marks: DataFrame, replace: bool = False, recursive: bool = False) -> DataFrame:
    """Record tracked files and globs (project, path, files, globs) on elements, and on descendants if asked."""
    targets = elements.select(
        *KEYS,
        F.explode(F.concat(ancestors_of(F.col("path")), F.array("path")) if recursive else F.array("path")).alias("mark"),
    )
    given = marks.select("project", F.col("path").alias("mark"), "files", "globs")
    gathered = (
        targets.join(given, ["project", "mark"])
        .groupBy(*KEYS)
        .agg(
            F.array_distinct(F.flatten(F.collect_list("files"))).alias("files"),
            F.array_distinct(F.flatten(F.collect_list("globs"))).alias("globs"),
        )
    )

    def merged(old: str, new: str) -> Column:
        fresh = F.col(new)
        joined = fresh if replace else F.array_union(old, new)
        return F.when(F.coalesce(F.size(fresh), F.lit(0)) > 0, joined).otherwise(F.col(old))

    return (
        elements.join(gathered, KEYS, "left")
        .withColumn("source_files", merged("source_files", "files"))
        .withColumn("source_globs", merged("source_globs", "globs"))
        .drop("files", "globs")
    )


def record_scan(elements: DataFrame, scanned: DataFrame, commits: DataFrame, at) -> DataFrame:
    """Set the baseline of scanned elements (project, path) to their project's commit (project, commit)."""
    mark = scanned.select(*KEYS, F.lit(True).alias("scanned")).distinct().join(commits, "project", "left")
    return (
        elements.join(mark, KEYS, "left")
        .withColumn("git_commit", F.when(F.col("scanned"), F.col("commit")).otherwise(F.col("git_commit")))
        .withColumn("updated", F.when(F.col("scanned"), F.lit(at).cast("timestamp")).otherwise(F.col("updated")))
        .drop("scanned", "commit")
    )
