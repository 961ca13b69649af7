"""Queries over coverage, change planning, search, extraction and change bursts."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborist.functions.common import paginate
from arborist.functions.paths import (
    ancestors_of,
    base_of,
    depth_of,
    dir_of,
    glob_to_regex,
    language_of,
    normalize_path,
    parent_of,
    resolve_relative,
    stem_of,
)
from arborist.functions.text import edit_distance, search_tokens, snippet, sql_lane_digest, word_count
from arborist.operators import coverage as cv
from arborist.operators import docs as dc
from arborist.operators import extract as ex
from arborist.operators import graph as g
from arborist.operators import history as hs
from arborist.operators import quality as ql
from arborist.operators import search as se
from arborist.operators import tracking as tr
from arborist.operators.diagrams import extract_refs, lint_diagrams
from arborist.plans.docs import SQL_LINT, SQL_SCORES
from arborist.plans.registry import Registry
from arborist.sources.corpus import apply_ignore, parse_change_log
from arborist.streaming import changes as st

R = Registry()
KEYS = ["project", "path"]

# The globs the derived elements carry, as expressions written by hand.
GLOB_REGEX = {
    "src/{api,data}/*.ts": "^src/(api|data)/[^/]*\\.ts$",
    "**/*.md": "^.*[^/]*\\.md$",
    "src/ui/**": "^src/ui/.*$",
    "src/ui/m[1-4]*.js": "^src/ui/m[1-4][^/]*\\.js$",
    "src/**/m?.ts": "^src/.*m[^/]\\.ts$",
}
SQL_GLOBS = (
    """
, el_globs AS (SELECT project, path, git_commit, unnest(source_globs) AS pat FROM meta)
, el_files AS (SELECT project, path, git_commit, updated, unnest(source_files) AS file FROM meta)
, gx AS (SELECT *, CASE pat """
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GLOB_REGEX.items())
    + """ ELSE concat('^', replace(replace(pat, '.', '\\.'), '*', '[^/]*'), '$') END AS rx FROM el_globs)
"""
)
SQL_COVERAGE = SQL_GLOBS + """
, c1 AS (SELECT project, file, max(path) AS element, 'source_files' AS method, 0 AS rank FROM el_files GROUP BY project, file)
, c2 AS (SELECT f.project, f.path AS file, min(x.path) AS element, 'source_globs' AS method, 1 AS rank FROM files f
    JOIN gx x ON x.project = f.project AND regexp_matches(f.path, x.rx) GROUP BY f.project, f.path)
, segs AS (SELECT project, path AS file, unnest(string_split(path, '/')) AS seg, generate_subscripts(string_split(path, '/'), 1) AS pos FROM files)
, nm AS (SELECT project, regexp_extract(path, '([^/]*)$', 1) AS name, min(path) AS element, count(*) AS candidates FROM meta GROUP BY ALL)
, c3 AS (SELECT s.project, s.file, nm.element, 'heuristic' AS method, 1000 - s.pos AS rank FROM segs s
    JOIN nm ON nm.project = s.project AND nm.name = regexp_replace(s.seg, '\\.[^.]+$', ''))
, cands AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3)
, cover AS (SELECT f.project, f.path, c.element, c.method FROM files f LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY project, file ORDER BY rank, element) AS rn FROM cands) c
    ON c.project = f.project AND c.file = f.path AND c.rn = 1)
"""

_cover = lambda d: cv.coverage_map(d["files"], d["meta"])
R.add("coverage_map", "files meta", _cover, SQL_COVERAGE + "SELECT * FROM cover")
R.add(
    "ambiguous_names",
    "files meta",
    lambda d: cv.ambiguous_names(d["meta"]),
    SQL_COVERAGE + "SELECT * FROM nm WHERE candidates > 1",
)
R.add(
    "uncovered_files",
    "files meta",
    lambda d: cv.uncovered_files(_cover(d)),
    SQL_COVERAGE + "SELECT project, path FROM cover WHERE element IS NULL",
)
R.add(
    "coverage_stats",
    "files meta",
    lambda d: cv.coverage_stats(_cover(d), d["meta"]),
    SQL_COVERAGE + """
    , a AS (SELECT project, count(*) AS source_files, count(element) AS covered_files FROM cover GROUP BY project)
    , u AS (SELECT DISTINCT project, element AS path FROM cover WHERE element IS NOT NULL)
    , b AS (SELECT m.project, count(*) AS elements, count(u.path) AS matched_elements, count(*) - count(u.path) AS orphaned_elements,
        count(*) FILTER (WHERE len(source_files) > 0) AS track_source_files, count(*) FILTER (WHERE len(source_files) = 0 AND len(source_globs) > 0) AS track_source_globs,
        count(*) FILTER (WHERE len(source_files) = 0 AND len(source_globs) = 0) AS track_heuristic
      FROM meta m LEFT JOIN u ON u.project = m.project AND u.path = m.path GROUP BY m.project)
    SELECT project, source_files, covered_files, source_files - covered_files AS uncovered_files, CAST(floor(covered_files / source_files * 100 + 0.5) AS BIGINT) AS coverage_pct,
      coalesce(elements, 0) AS elements, coalesce(matched_elements, 0) AS matched_elements, coalesce(orphaned_elements, 0) AS orphaned_elements,
      coalesce(track_source_files, 0) AS track_source_files, coalesce(track_source_globs, 0) AS track_source_globs, coalesce(track_heuristic, 0) AS track_heuristic
    FROM a LEFT JOIN b USING (project)""",
)
R.add(
    "top_uncovered_dirs",
    "files meta",
    lambda d: cv.top_uncovered_dirs(_cover(d)),
    SQL_COVERAGE + """, n AS (SELECT project, regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS files FROM cover WHERE element IS NULL GROUP BY ALL)
      SELECT project, dir, files FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY files DESC, dir) AS rn FROM n) x WHERE rn <= 5""",
)
R.add(
    "dominant_element",
    "files meta",
    lambda d: cv.dominant_element(_cover(d)),
    SQL_COVERAGE + """, n AS (SELECT project, regexp_replace(path, '/[^/]*$', '') AS dir, element, count(*) AS n FROM cover WHERE element IS NOT NULL GROUP BY ALL)
      SELECT project, dir, element FROM (SELECT *, row_number() OVER (PARTITION BY project, dir ORDER BY n DESC, element) AS rn FROM n) x WHERE rn = 1""",
)
R.add(
    "orphaned_elements",
    "files meta",
    lambda d: cv.orphaned_elements(_cover(d), d["meta"]),
    SQL_COVERAGE + """SELECT project, path, CASE WHEN len(source_files) > 0 THEN 'source_files point to deleted/moved files'
      WHEN len(source_globs) > 0 THEN 'source_globs match no current files' ELSE 'no source_files, no directory match' END AS reason
      FROM meta m WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.project = m.project AND c.element = m.path)""",
)
SQL_ORPHANS = SQL_GLOBS + """
, orph AS (SELECT project, path, file FROM el_files e WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.project = e.project AND f.path = e.file))
"""
_orphans = lambda d: cv.orphaned_sources(d["meta"], d["files"])
R.add("orphaned_sources", "files meta", _orphans, SQL_ORPHANS + "SELECT * FROM orph")

# ---- change planning -----------------------------------------------------------------

R.add(
    "dedupe_changes",
    "changes",
    lambda d: tr.dedupe_changes(d["changes"]),
    """SELECT project, path, status FROM (SELECT *, row_number() OVER (PARTITION BY project, path
       ORDER BY CASE WHEN ref IS NULL THEN 1 ELSE 0 END, seq) AS rn FROM changes) x WHERE rn = 1""",
)
R.add(
    "union_changes",
    "changes",
    lambda d: tr.union_changes(d["changes"].where("ref IS NOT NULL"), d["changes"].where("ref IS NULL").drop("ref")),
    """SELECT project, path, status FROM (SELECT *, row_number() OVER (PARTITION BY project, path
       ORDER BY CASE WHEN ref IS NULL THEN 1 ELSE 0 END, seq) AS rn FROM changes) x WHERE rn = 1""",
)
SQL_HITS = SQL_ORPHANS + """
, hits AS (SELECT project, path, file, CASE WHEN min(rank) = 0 THEN 'source_file' ELSE 'source_glob' END AS reason FROM (
    SELECT e.project, e.path, c.path AS file, 0 AS rank FROM el_files e JOIN changes c ON c.project = e.project AND c.path = e.file
      AND (c.ref IS NULL OR c.ref = e.git_commit)
    UNION ALL SELECT e.project, e.path, c.path, 1 FROM gx e JOIN changes c ON c.project = e.project AND regexp_matches(c.path, e.rx)
      AND (c.ref IS NULL OR c.ref = e.git_commit)) x GROUP BY project, path, file)
"""
R.add(
    "change_hits",
    "meta changes files",
    lambda d: tr.change_hits(d["meta"], d["changes"]),
    SQL_HITS + "SELECT * FROM hits",
)
SQL_PLAN = SQL_HITS + """
, own AS (SELECT project, path, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, count(DISTINCT file) AS n FROM (
    SELECT * FROM hits UNION ALL SELECT *, 'orphaned_source' FROM orph) x GROUP BY project, path)
, newer AS (SELECT e.project, e.path, count(DISTINCT e.file) AS n FROM el_files e JOIN files f ON f.project = e.project AND f.path = e.file
    WHERE e.git_commit IS NULL AND f.mtime > e.updated GROUP BY ALL)
, seen AS (SELECT m.project, m.path, count(DISTINCT c.path) AS n FROM meta m JOIN changes c ON c.project = m.project
    AND (c.ref IS NULL OR c.ref = m.git_commit) WHERE len(source_files) + len(source_globs) = 0 GROUP BY ALL)
, decided AS (SELECT m.project, m.path, len(source_files) + len(source_globs) = 0 AS untracked,
      CASE WHEN len(source_files) + len(source_globs) = 0 THEN CASE WHEN s.n > 0 THEN 'stale' ELSE 'open' END
           WHEN o.n > 0 OR w.n > 0 THEN 'stale' ELSE 'fresh' END AS status,
      CASE WHEN len(source_files) + len(source_globs) = 0 THEN CASE WHEN s.n > 0 THEN 'no_source_tracking' END
           WHEN o.n > 0 THEN o.reasons WHEN w.n > 0 THEN 'source_file_mtime' END AS reasons,
      CASE WHEN len(source_files) + len(source_globs) = 0 THEN coalesce(s.n, 0) ELSE coalesce(o.n, w.n, 0) END AS matched
    FROM meta m LEFT JOIN own o ON o.project = m.project AND o.path = m.path LEFT JOIN newer w ON w.project = m.project AND w.path = m.path
    LEFT JOIN seen s ON s.project = m.project AND s.path = m.path)
, heirs AS (SELECT DISTINCT o.project, o.path FROM decided o JOIN decided s ON s.project = o.project AND s.status = 'stale'
    AND starts_with(o.path, concat(s.path, '/')) WHERE o.status = 'open')
, donors AS (SELECT project, path FROM decided WHERE status = 'stale' UNION SELECT * FROM heirs)
, near AS (SELECT h.project, h.path, arg_max(d.path, length(d.path)) AS inherited_from FROM heirs h JOIN donors d ON d.project = h.project
    AND starts_with(h.path, concat(d.path, '/')) GROUP BY ALL)
, plan AS (SELECT d.project, d.path, CASE WHEN d.status <> 'open' THEN d.status WHEN n.path IS NOT NULL THEN 'stale' ELSE 'unknown' END AS status,
    CASE WHEN n.path IS NOT NULL THEN 'no_source_tracking' ELSE d.reasons END AS reasons,
    CASE WHEN n.path IS NOT NULL THEN 1 ELSE d.matched END AS matched, n.inherited_from
  FROM decided d LEFT JOIN near n ON n.project = d.project AND n.path = d.path)
"""
_plan = lambda d: tr.plan_incremental(d["meta"], d["changes"], d["files"])
R.add("plan_incremental", "meta changes files", _plan, SQL_PLAN + "SELECT * FROM plan")
R.add(
    "plan_without_git",
    "meta changes files",
    lambda d: tr.plan_incremental(d["meta"], d["changes"], d["files"], has_git=False),
    ", no_changes AS (SELECT * FROM changes WHERE false)"
    + SQL_PLAN.replace("JOIN changes", "JOIN no_changes").replace("e.git_commit IS NULL AND f.mtime", "f.mtime")
    + "SELECT * FROM plan",
)
R.add(
    "changed_only",
    "meta changes files fields",
    lambda d: tr.changed_only(d["fields"].select(*KEYS, "field"), _plan(d)),
    SQL_PLAN + """SELECT project, path, field FROM fields f WHERE EXISTS (SELECT 1 FROM plan p WHERE p.project = f.project AND p.path = f.path
      AND p.status IN ('stale', 'unknown'))""",
)
R.add(
    "explain",
    "meta changes files snapshot_old elements",
    lambda d: tr.explain(
        d["meta"].select(*KEYS).unionByName(d["snapshot_old"].select(*KEYS)), _plan(d), d["elements"].select(*KEYS, F.length("path").alias("score"))
    ).select(*KEYS, "status", "reasons", "score"),
    SQL_PLAN + """SELECT x.*, CAST(length(e.path) AS INTEGER) AS score FROM (SELECT project, path, status, reasons FROM plan
      UNION ALL SELECT project, path, 'not found', NULL FROM (SELECT DISTINCT project, path FROM snapshot_old)) x
      LEFT JOIN elements e ON e.project = x.project AND e.path = x.path""",
)
R.add(
    "changed_vs_deleted",
    "changes files",
    lambda d: tr.changed_vs_deleted(d["changes"], d["files"], "src/data"),
    """SELECT DISTINCT c.project, c.path, CASE WHEN f.path IS NOT NULL THEN 'existing' ELSE 'deleted' END AS state FROM changes c
       LEFT JOIN files f ON f.project = c.project AND f.path = c.path WHERE starts_with(c.path, 'src/data/')""",
)
_SQL_ITEM = "concat(kind, ':', name, ':', line, ':', end_line)"
SQL_PRINTS = f"""
, fpo AS (SELECT project, file, substring({sql_lane_digest(_SQL_ITEM)}, 1, 16) AS h, count(*) AS n FROM old_definitions GROUP BY project, file)
, fpn AS (SELECT project, file, substring({sql_lane_digest(_SQL_ITEM)}, 1, 16) AS h, count(*) AS n FROM new_definitions GROUP BY project, file)
, cf AS (SELECT project, file, o.n AS n_old, w.n AS n_new FROM fpo o FULL JOIN fpn w USING (project, file) WHERE o.h IS NULL OR w.h IS NULL OR o.h <> w.h)
, od AS (SELECT project, file, kind, name, max(line * 100000 + end_line) AS a FROM old_definitions GROUP BY ALL)
, nd AS (SELECT project, file, kind, name, max(line * 100000 + end_line) AS b FROM new_definitions GROUP BY ALL)
, dch AS (SELECT project, file, kind, name, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM od FULL JOIN nd USING (project, file, kind, name) WHERE a IS NULL OR b IS NULL OR a <> b)
, dn AS (SELECT project, file, count(*) FILTER (WHERE change = 'added') AS a, count(*) FILTER (WHERE change = 'removed') AS r,
    count(*) FILTER (WHERE change = 'modified') AS m FROM dch GROUP BY ALL)
, delta AS (SELECT project, file, CASE WHEN n_old IS NULL THEN n_new ELSE coalesce(a, 0) END AS added,
    CASE WHEN n_new IS NULL THEN n_old ELSE coalesce(r, 0) END AS removed, coalesce(m, 0) AS modified, n_old, n_new FROM cf LEFT JOIN dn USING (project, file))
, deltas AS (SELECT project, file, added, removed, modified, CASE WHEN n_old IS NULL OR n_new IS NULL THEN 0 ELSE n_new - added - modified END AS unchanged,
    added + removed + modified > 0 AS has_changes FROM delta)
"""
_deltas = lambda d: tr.fingerprint_deltas(d["old_definitions"], d["new_definitions"])
R.add(
    "file_fingerprints",
    "old_definitions new_definitions",
    lambda d: tr.file_fingerprints(d["new_definitions"]),
    SQL_PRINTS + "SELECT project, file, h AS hash, n AS n_items FROM fpn",
)
R.add(
    "definition_changes",
    "old_definitions new_definitions",
    lambda d: tr.definition_changes(d["old_definitions"], d["new_definitions"]),
    SQL_PRINTS + "SELECT * FROM dch",
)
R.add("fingerprint_deltas", "old_definitions new_definitions", _deltas, SQL_PRINTS + "SELECT * FROM deltas")
R.add(
    "deltas_to_elements",
    "old_definitions new_definitions meta",
    lambda d: tr.deltas_to_elements(_deltas(d), d["meta"]),
    SQL_GLOBS + SQL_PRINTS + """, m AS (SELECT project, file FROM deltas WHERE has_changes)
      SELECT e.project, e.path, m.file FROM el_files e JOIN m ON m.project = e.project AND m.file = e.file
      UNION SELECT e.project, e.path, m.file FROM gx e JOIN m ON m.project = e.project AND regexp_matches(m.file, e.rx)""",
)
R.add(
    "apply_orphan_fix",
    "meta files",
    lambda d: tr.apply_orphan_fix(d["meta"], _orphans(d)).select(*KEYS, F.array_join("source_files", ",").alias("source_files"), "removed"),
    SQL_ORPHANS + """SELECT m.project, m.path, array_to_string(list_filter(source_files, lambda f: NOT list_contains(coalesce(o.l, []), f)), ',') AS source_files,
      CAST(len(list_filter(source_files, lambda f: list_contains(coalesce(o.l, []), f))) AS INTEGER) AS removed
      FROM meta m LEFT JOIN (SELECT project, path, list(file) AS l FROM orph GROUP BY ALL) o ON o.project = m.project AND o.path = m.path""",
)


def _marks(d):
    return d["meta"].where(~F.col("path").contains("/")).select(
        *KEYS, F.array(F.lit("src/new.ts")).alias("files"), F.array(F.lit("src/new/**"), F.lit("src/ui/**")).alias("globs")
    )


R.add(
    "update_tracking",
    "meta",
    lambda d: tr.update_tracking(d["meta"], _marks(d), recursive=True).select(
        *KEYS, F.array_join(F.array_sort("source_files"), ",").alias("source_files"), F.array_join(F.array_sort("source_globs"), ",").alias("source_globs")
    ),
    """SELECT project, path, array_to_string(list_sort(list_distinct(list_append(source_files, 'src/new.ts'))), ',') AS source_files,
       array_to_string(list_sort(list_distinct(list_concat(source_globs, ['src/new/**', 'src/ui/**']))), ',') AS source_globs FROM meta""",
)
R.add(
    "record_scan",
    "meta changes",
    lambda d: tr.record_scan(
        d["meta"], d["meta"].where(F.col("path").contains("/")), d["changes"].groupBy("project").agg(F.max("ref").alias("commit")), "2024-02-01 00:00:00"
    ).select(*KEYS, "git_commit", "updated"),
    """SELECT m.project, m.path, CASE WHEN contains(m.path, '/') THEN c.ref ELSE git_commit END AS git_commit,
       CASE WHEN contains(m.path, '/') THEN TIMESTAMP '2024-02-01 00:00:00' ELSE updated END AS updated
       FROM meta m LEFT JOIN (SELECT project, max(ref) AS ref FROM changes GROUP BY project) c ON c.project = m.project""",
)
R.add(
    "reconcile_report",
    "meta files elements fields",
    lambda d: _reconcile(d),
    SQL_ORPHANS + """, r AS (SELECT DISTINCT project, path, unnest(regexp_extract_all(text, '@([\\w-]+)', 1)) AS target FROM fields WHERE field = 'diagram')
      SELECT project, path, 'orphaned_source' AS kind, file AS detail FROM orph
      UNION ALL SELECT project, path, 'missing_description', NULL FROM elements e WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.project = e.project AND f.path = e.path AND field = 'description')
      UNION ALL SELECT project, path, 'missing_diagram', NULL FROM elements e WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.project = e.project AND f.path = e.path AND field = 'diagram')
      UNION ALL SELECT project, path, 'broken_ref', target FROM r WHERE target <> path AND NOT EXISTS (SELECT 1 FROM elements e WHERE e.project = r.project AND e.path = r.target)
      UNION ALL SELECT project, path, 'empty_element', NULL FROM elements e WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.project = e.project AND f.path = e.path)""",
)


R.add(
    "has_issues",
    "elements fields meta files",
    lambda d: ql.has_issues(_reconcile(d), dc.check_signature(d["elements"], dc.signature(d["elements"].where("path NOT LIKE 'es%'")).select("project", "signature"))),
    SQL_ORPHANS + f""", r AS (SELECT DISTINCT project, path, unnest(regexp_extract_all(text, '@([\\w-]+)', 1)) AS target FROM fields WHERE field = 'diagram')
      , bad AS (SELECT project FROM orph UNION SELECT project FROM r WHERE target <> path AND NOT EXISTS (SELECT 1 FROM elements e WHERE e.project = r.project AND e.path = r.target)
        UNION SELECT project FROM elements e WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.project = e.project AND f.path = e.path))
      , cur AS (SELECT project, {sql_lane_digest('path')} AS now FROM elements GROUP BY project)
      , sto AS (SELECT project, {sql_lane_digest('path')} AS was FROM elements WHERE NOT starts_with(path, 'es') GROUP BY project)
      SELECT project, project IN (SELECT project FROM bad) OR was IS NULL OR was <> now AS has_issues FROM cur LEFT JOIN sto USING (project)""",
)


def _reconcile(d):
    return ql.reconcile_report(d["elements"], d["fields"], _orphans(d))


def _changed_lint(d):
    issues = lint_diagrams(d["fields"], d["elements"])
    return tr.changed_only(issues, _plan(d)).select(*KEYS, "line", "level", "rule", "message")


R.add(
    "lint_changed_only",
    "fields elements meta changes files",
    _changed_lint,
    SQL_LINT + SQL_PLAN + """SELECT project, path, CAST(line AS INTEGER) AS line, level, rule, message FROM lint x
      WHERE EXISTS (SELECT 1 FROM plan p WHERE p.project = x.project AND p.path = x.path AND p.status IN ('stale', 'unknown'))""",
)
R.add(
    "inspect_elements",
    "elements fields flows meta files changes links",
    lambda d: _inspect(d),
    SQL_SCORES + SQL_PLAN + """
    , facts AS (SELECT project, path, count(*) FILTER (WHERE regexp_matches(text, '\\S')) AS present,
        sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS words,
        bool_or(field = 'diagram' AND regexp_matches(text, '\\S')) AS has_diagram FROM fields GROUP BY ALL)
    , linked AS (SELECT project, path, count(*) AS links FROM links GROUP BY ALL)
    SELECT e.project, e.path, CASE WHEN NOT contains(e.path, '/') THEN 'perspective' WHEN coalesce(f.has_diagram, false) THEN 'group' ELSE 'leaf' END AS type,
      CAST(floor(coalesce(f.present, 0) / 7 * 100 + 0.5) AS BIGINT) AS field_coverage, CAST(coalesce(f.words, 0) AS BIGINT) AS words, coalesce(s.score, 0) AS score,
      coalesce(p.status, 'unknown') AS status, p.reasons, coalesce(l.links, 0) AS links, coalesce(k.children, 0) AS children, coalesce(k.covered, 0) AS covered
    FROM elements e LEFT JOIN facts f ON f.project = e.project AND f.path = e.path LEFT JOIN kids k ON k.project = e.project AND k.path = e.path
    LEFT JOIN scores s ON s.project = e.project AND s.path = e.path LEFT JOIN plan p ON p.project = e.project AND p.path = e.path
    LEFT JOIN linked l ON l.project = e.project AND l.path = e.path""",
)
R.add(
    "inspect_children",
    "elements fields flows",
    lambda d: ql.inspect_children(d["elements"], d["fields"], _scores(d)),
    SQL_SCORES + """
    , kind AS (SELECT e.project, e.path, CASE WHEN d.path IS NOT NULL THEN 'group' ELSE 'leaf' END AS type
        FROM elements e LEFT JOIN drawn d ON d.project = e.project AND d.path = e.path WHERE contains(e.path, '/'))
    SELECT k.project, regexp_replace(k.path, '/[^/]*$', '') AS parent, regexp_extract(k.path, '([^/]*)$', 1) AS name, k.type, k.type = 'group' AS has_diagram,
      coalesce(s.score, 0) AS score FROM kind k LEFT JOIN scores s ON s.project = k.project AND s.path = k.path""",
)


def _scores(d):
    return ql.score_elements(d["elements"], d["fields"], d["flows"], extract_refs(d["fields"]), lint_diagrams(d["fields"], d["elements"]))


def _inspect(d):
    return ql.inspect_elements(d["elements"], d["fields"], _scores(d), _plan(d), d["links"])


# ---- search ----------------------------------------------------------------------------

FUZZY = ["en", "good", "doc1", "fr/raw", "the", "gd"]
R.add(
    "fuzzy_search",
    "elements fields",
    lambda d: se.fuzzy_search(d["elements"], d["fields"], FUZZY),
    f""", docs2 AS (SELECT e.project, e.path, f.text, lower(regexp_extract(e.path, '([^/]*)$', 1)) AS name, unnest({FUZZY}) AS query
        FROM elements e LEFT JOIN fields f ON f.project = e.project AND f.path = e.path AND f.field = 'description')
    , s AS (SELECT *, CASE WHEN name = query THEN 100 WHEN contains(name, query) THEN 80 WHEN contains(lower(path), query) THEN 60
        WHEN contains(lower(coalesce(text, '')), query) THEN 40 WHEN regexp_matches(name, array_to_string(string_split(query, ''), '.*')) THEN 20 END AS score FROM docs2)
    SELECT project, path, query, score, CASE score WHEN 60 THEN 'path' WHEN 40 THEN 'description' ELSE 'name' END AS match,
      CASE WHEN score = 40 THEN substring(text, 1, 100) END AS snippet FROM (
      SELECT *, row_number() OVER (PARTITION BY project, query ORDER BY score DESC, path) AS rn FROM s WHERE score IS NOT NULL) x WHERE rn <= 20""",
)
QUERY = "Characters size dei"
SQL_WEIGHTED = """
, sw AS (SELECT project, path, field, lower(text) AS low, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2)) AS words FROM fields WHERE regexp_matches(text, '\\S'))
, st AS (SELECT project, path, field,
    CASE WHEN contains(low, 'characters') THEN 20 ELSE coalesce(list_max(list_transform(list_filter(words, lambda w: abs(length(w) - 10) <= 2 AND levenshtein('characters', w) <= 2), lambda w: (10 - levenshtein('characters', w)) * 1.5)), 0) END
    + CASE WHEN contains(low, 'size') THEN 8 ELSE coalesce(list_max(list_transform(list_filter(words, lambda w: abs(length(w) - 4) <= 1 AND levenshtein('size', w) <= 1), lambda w: (4 - levenshtein('size', w)) * 1.5)), 0) END
    + CASE WHEN contains(low, 'dei') THEN 6 ELSE coalesce(list_max(list_transform(list_filter(words, lambda w: abs(length(w) - 3) <= 1 AND levenshtein('dei', w) <= 1), lambda w: (3 - levenshtein('dei', w)) * 1.5)), 0) END
    + CASE WHEN contains(low, 'characters size dei') THEN 57 ELSE 0 END AS s,
    CASE field WHEN 'description' THEN 4.0 WHEN 'context' THEN 2.5 WHEN 'constraint' THEN 2.0 WHEN 'concern' THEN 1.5 WHEN 'note' THEN 0.5 ELSE 1.0 END AS w FROM sw)
, wh AS (SELECT project, path, field, CAST(floor(CAST(s * w AS DOUBLE) * 10 + 0.5) / 10 AS DOUBLE) AS score FROM st WHERE s * w >= 2)
"""
R.add(
    "weighted_search",
    "fields",
    lambda d: se.weighted_search(d["fields"], QUERY),
    SQL_WEIGHTED + "SELECT * FROM wh",
)
R.add(
    "search_page",
    "fields",
    lambda d: se.search_page(se.weighted_search(d["fields"], QUERY), 10, 5).withColumn("position", F.col("position").cast("bigint")),
    SQL_WEIGHTED + """SELECT project, path, field, score, rn AS position, total FROM (
      SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, path, field) AS rn, count(*) OVER (PARTITION BY project) AS total FROM wh) x WHERE rn BETWEEN 6 AND 15""",
)
R.add(
    "paginate",
    "fields",
    lambda d: paginate(se.weighted_search(d["fields"], QUERY), [F.desc("score"), F.asc("project"), F.asc("path"), F.asc("field")], 80, 7),
    SQL_WEIGHTED + "SELECT * FROM wh ORDER BY score DESC, project, path, field LIMIT 50 OFFSET 7",
)
R.add(
    "tagged_search",
    "fields meta",
    lambda d: se.weighted_search(d["fields"], "tag:GOOD size", d["meta"]),
    SQL_WEIGHTED.split(", st AS")[0] + """
    , st AS (SELECT s.project, s.path, s.field, CASE WHEN contains(low, 'size') THEN 16 ELSE coalesce(list_max(list_transform(list_filter(words, lambda w: abs(length(w) - 4) <= 1 AND levenshtein('size', w) <= 1), lambda w: (4 - levenshtein('size', w)) * 1.5)), 0) END
        + CASE WHEN contains(low, 'size') THEN 4 ELSE 0 END AS s,
        CASE s.field WHEN 'description' THEN 4.0 WHEN 'context' THEN 2.5 WHEN 'constraint' THEN 2.0 WHEN 'concern' THEN 1.5 WHEN 'note' THEN 0.5 ELSE 1.0 END AS w
      FROM sw s JOIN meta m ON m.project = s.project AND m.path = s.path AND list_contains(list_transform(tags, lambda t: lower(t)), 'good'))
    SELECT project, path, field, CAST(floor(CAST(s * w AS DOUBLE) * 10 + 0.5) / 10 AS DOUBLE) AS score FROM st WHERE s * w >= 2""",
)
R.add(
    "featured",
    "meta",
    lambda d: se.featured(d["meta"]).withColumn("why", F.lit("top")).unionByName(se.featured(d["meta"], ["topic"], 2).withColumn("why", F.lit("tag"))),
    """SELECT DISTINCT project, split_part(path, '/', 1) AS path, 'top' AS why FROM meta
       UNION ALL SELECT project, path, 'tag' FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) AS rn FROM meta WHERE list_contains(tags, 'Topic')) x WHERE rn <= 2""",
)
BM25_QUERIES = ["size characters", "en good", "toxic", "the and"]


def sql_bm25(texts: str, queries: list[str]) -> str:
    pairs = ", ".join(f"('{q}', '{t}', {len(q.split())})" for q in queries for t in q.split())
    return f"""
, tx AS ({texts})
, tok AS (SELECT project, doc, unnest(list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '')) AS term FROM tx)
, tf AS (SELECT project, doc, term, count(*) AS tf FROM tok GROUP BY ALL)
, dl AS (SELECT project, doc, count(*) AS dl FROM tok GROUP BY ALL)
, dn AS (SELECT project, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY project)
, dfx AS (SELECT project, term, count(*) AS df FROM tf GROUP BY ALL)
, q(query, term, need) AS (VALUES {pairs})
, sc AS (SELECT project, query, doc, need, count(*) AS have, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM q JOIN tf USING (term) JOIN dfx USING (project, term) JOIN dl USING (project, doc) JOIN dn USING (project) GROUP BY ALL)
SELECT project, query, doc, score, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY project, query ORDER BY score DESC, doc) AS rn FROM sc WHERE have = need) x WHERE rn <= 20"""


def _bm25(texts, queries):
    out = se.bm25_search(se.build_postings(texts), se.doc_lengths(texts), queries)
    return out.withColumn("position", F.col("position").cast("bigint"))


R.add(
    "bm25_search",
    "elements fields",
    lambda d: _bm25(se.searchable_texts(d["elements"], d["fields"]), BM25_QUERIES),
    sql_bm25(
        """SELECT project, path AS doc, concat(path, ' ', regexp_extract(path, '([^/]*)$', 1)) AS text FROM elements
           UNION ALL SELECT project, path, text FROM fields WHERE field IN ('description', 'context', 'concern', 'todo', 'note')""",
        BM25_QUERIES,
    ),
)
FILE_QUERIES = ["function red", "typescript widget", "data js"]
R.add(
    "bm25_search_files",
    "files code_definitions",
    lambda d: _bm25(se.file_texts(d["files"], d["code_definitions"], language_of(F.col("path"))), FILE_QUERIES),
    sql_bm25(
        """SELECT project, path AS doc, concat(path, ' ', CASE WHEN path LIKE '%.js' THEN 'javascript' ELSE 'typescript' END) AS text FROM files
           UNION ALL SELECT project, file, concat(kind, ' ', name) FROM code_definitions""",
        FILE_QUERIES,
    ),
)
R.add(
    "postings",
    "fields",
    lambda d: se.build_postings(d["fields"].select("project", F.col("path").alias("doc"), "text")),
    """, tok AS (SELECT project, path AS doc, unnest(list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '')) AS term FROM fields)
       SELECT project, doc, term, count(*) AS tf FROM tok GROUP BY ALL""",
)
R.add("search_snippets", "fields", lambda d: se.weighted_search(d["fields"], "size characters", with_snippet=True))

# ---- functions over whole tables ----------------------------------------------------------

R.add(
    "path_functions",
    "files",
    lambda d: d["files"].select(
        *KEYS,
        dir_of(F.col("path")).alias("dir"),
        base_of(F.col("path")).alias("base"),
        stem_of(F.col("path")).alias("stem"),
        parent_of(F.col("path")).alias("parent"),
        depth_of(F.col("path")).alias("depth"),
        F.array_join(ancestors_of(F.col("path")), ",").alias("ancestors"),
        normalize_path(F.concat(F.lit(".\\"), F.col("path"), F.lit("//"))).alias("normal"),
        resolve_relative(F.col("path"), F.lit("./../x/./y/../z")).alias("resolved"),
    ),
    """SELECT project, path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_replace(path, '\\.[^.]+$', '') AS stem,
       regexp_replace(path, '/[^/]*$', '') AS parent, CAST(3 AS INTEGER) AS depth, concat('src,', regexp_replace(path, '/[^/]*$', '')) AS ancestors, path AS normal,
       'src/x/z' AS resolved FROM files""",
)
R.add(
    "glob_to_regex",
    "meta",
    lambda d: d["meta"].select(F.explode("source_globs").alias("pat")).groupBy("pat", glob_to_regex(F.col("pat")).alias("regex")).agg(F.count(F.lit(1)).alias("n")),
    SQL_GLOBS.split(", el_files")[0] + """
      SELECT pat, CASE pat WHEN 'src/{api,data}/*.ts' THEN '^src/(?:api|data)/[^/]*\\.ts$' WHEN '**/*.md' THEN '^.*[^/]*\\.md$' WHEN 'src/ui/**' THEN '^src/ui/.*$'
        WHEN 'src/ui/m[1-4]*.js' THEN '^src/ui/m[1-4][^/]*\\.js$' WHEN 'src/**/m?.ts' THEN '^src/.*m[^/]\\.ts$'
        ELSE concat('^', replace(replace(pat, '.', '\\.'), '*', '[^/]*'), '$') END AS regex, count(*) AS n FROM el_globs GROUP BY ALL""",
)
R.add(
    "text_functions",
    "docs",
    lambda d: d["docs"].select(
        "doc_id",
        word_count(F.col("text")).alias("words"),
        F.size(search_tokens(F.col("text"))).alias("tokens"),
        F.array_min(F.transform(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda w: edit_distance(w, F.lit("their")))).alias("distance"),
        F.size(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda w: edit_distance(w, F.lit("the"), 1) >= 0)).alias("near_words"),
    ),
    """SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words,
       CAST(len(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s_-]', ' ', 'g'), '[\\s_-]+'), lambda t: length(t) >= 2))) AS INTEGER) AS tokens,
       CAST(list_min(list_transform(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: levenshtein(w, 'their'))) AS INTEGER) AS distance,
       CAST(len(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: levenshtein(w, 'the') <= 1)) AS INTEGER) AS near_words FROM docs""",
)
def _sql_snippet(text: str) -> str:
    """CTE `said` (doc_id, snippet) for the query `the or` over `docs`."""
    esc = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    styled = lambda c: (
        f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g'), "
        "'\\*(.+?)\\*', '<em>\\1</em>', 'g'), '`([^`]+)`', '<code>\\1</code>', 'g'), "
        "'\\[([^\\]]+)\\]\\(([^)]+)\\)', '<a href=\"\\2\" style=\"color:inherit\">\\1</a>', 'g')"
    )
    near = lambda w: f"list_filter(words, lambda w: levenshtein('{w}', w) <= 1)[1]"
    before = "regexp_replace(substring(text, lo, pos - lo), '^\\s+', '')"
    after = "regexp_replace(substring(text, pos + size, hi - pos - size), '\\s+$', '')"
    return f"""
    , low AS (SELECT doc_id, {text} AS text, lower({text}) AS low, instr(lower({text}), 'the or') AS p, instr(lower({text}), 'the') AS t1, instr(lower({text}), 'or') AS t2,
        list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda w: length(w) >= 2) AS words FROM docs)
    , found AS (SELECT *, coalesce({near('the')}, {near('or')}) AS word FROM low)
    , hit AS (SELECT doc_id, text,
        CASE WHEN p > 0 THEN p WHEN t1 > 0 AND (t2 = 0 OR t1 <= t2) THEN t1 WHEN t2 > 0 THEN t2 WHEN word IS NOT NULL THEN instr(low, word) ELSE 0 END AS pos,
        CASE WHEN p > 0 THEN 6 WHEN t1 > 0 AND (t2 = 0 OR t1 <= t2) THEN 3 WHEN t2 > 0 THEN 2 ELSE coalesce(length(word), 0) END AS size FROM found)
    , span AS (SELECT *, greatest(pos - 90, 1) AS lo, least(length(text) + 1, pos + size + 140) AS hi FROM hit)
    , said AS (SELECT doc_id, CASE WHEN pos > 0 THEN concat(CASE WHEN lo > 1 THEN '…' ELSE '' END, {styled(esc(before))},
        '<mark>', {esc('substring(text, pos, size)')}, '</mark>', {styled(esc(after))}, CASE WHEN hi <= length(text) THEN '…' ELSE '' END)
      ELSE concat({styled(esc("regexp_replace(substring(text, 1, 220), '^\\s+|\\s+$', '', 'g')"))}, CASE WHEN length(text) > 220 THEN '…' ELSE '' END) END AS snippet FROM span)"""


R.add(
    "snippet",
    "docs",
    lambda d: d["docs"].select("doc_id", snippet(F.col("text"), "the or").alias("snippet")),
    _sql_snippet("text") + "SELECT * FROM said",
)

# ---- extraction -----------------------------------------------------------------------------

R.add(
    "extract_imports",
    "uses source_files",
    lambda d: ex.extract_imports(d["source_files"]).select(
        "project", "file", "source", F.array_join("specifiers", ",").alias("names"), "default_name", "resolved"
    ),
    """SELECT project, file, regexp_extract(line_text, 'from ''([^'']*)''', 1) AS source, regexp_extract(line_text, '\\{ (\\w+) \\}', 1) AS names,
       CASE WHEN contains(line_text, '{') THEN NULL ELSE regexp_extract(line_text, '^import (\\w+) from', 1) END AS default_name,
       concat('src/', regexp_extract(line_text, 'from ''\\.\\./([^'']*)''', 1)) AS resolved FROM source_lines WHERE block = 0""",
)
R.add(
    "extract_exports",
    "source_files exports",
    lambda d: ex.extract_exports(d["source_files"], lexical=True).select("project", "file", "name", "kind"),
    "SELECT project, file, name, kind FROM exports",
)
R.add(
    "resolve_imports",
    "source_files edges",
    lambda d: g.resolve_imports(ex.extract_imports(d["source_files"]), d["files"]).select(
        "project", "src", "dst", F.array_join("imports", ",").alias("names")
    ),
    "SELECT project, src, dst, array_to_string(imports, ',') AS names FROM edges",
)
R.add(
    "hotspots_from_source",
    "source_files edges",
    lambda d: g.hotspots(g.resolve_imports(ex.extract_imports(d["source_files"]), d["source_files"])).select("project", "file", "fan_in"),
    """, n AS (SELECT project, dst AS file, count(*) AS fan_in FROM edges GROUP BY ALL)
       SELECT project, file, fan_in FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY fan_in DESC, file) AS rn FROM n) x WHERE rn <= 20""",
)


#: Route declarations in the style of each framework: file ending, lines above, text of one declaration ({r}: path, {h}: handler).
_STYLES = [
    ("express", ".js", "", "app.get('/{r}', handlers.{h}); app.post('/{r}', x, y);"),
    ("django", "urls.py", "urlpatterns = [", "    path('{r}', views.{h}),"),
    ("flask", "f.py", "from flask import x", "@bp.route('/{r}')\n# who asks\n@login\ndef {h}(a):\n    return a"),
    ("fastapi", "a.py", "from fastapi import x", "@router.put('/{r}')\nasync def {h}(a):\n    return a"),
    ("spring", ".java", '@RequestMapping("/api")\npublic class Routes {{', '  @GetMapping("/{r}")\n  // note\n  public String {h}(int a) {{ return b(a); }}'),
    ("nestjs", ".ts", "@Controller('x')\nexport class Routes {{", "  @Post('/{r}')\n  async {h}(a) {{ return a; }}"),
    ("gin", ".go", "package x", '  r.GET("/{r}", {h})'),
]
_VERB = {"express": "GET", "django": "ANY", "flask": "ANY", "fastapi": "PUT", "spring": "GET", "nestjs": "POST", "gin": "GET"}


def _web(d):
    """Every line item as a route declaration of its project, in one of the frameworks' styles."""

    def pick(value):
        out = F.lit("")
        for k, style in enumerate(_STYLES):
            out = F.when(F.col("dst_id") % len(_STYLES) == k, value(style)).otherwise(out)
        return out

    name, handler = F.concat(F.lit("r"), F.col("src_id")), F.concat(F.lit("h"), F.col("partkey"))
    text = pick(lambda s: F.replace(F.replace(F.lit(s[3].replace("{{", "{").replace("}}", "}")), F.lit("{r}"), name), F.lit("{h}"), handler))
    path = F.concat(F.lit("src/routes"), F.col("dst_id"), pick(lambda s: F.lit(s[1])))
    head = pick(lambda s: F.lit(s[2].replace("{{", "{").replace("}}", "}")))
    rows = d["uses"].select("project", path.alias("path"), head.alias("head"), text.alias("text"))
    body = F.array_join(F.sort_array(F.collect_list("text")), "\n")
    return rows.groupBy("project", "path", "head").agg(body.alias("body")).select("project", "path", F.concat_ws("\n", "head", "body").alias("content"))


def _sql_web() -> str:
    """The same declarations as rows: framework, file, path, handler and line."""
    quote = lambda x: "'" + x.replace("{{", "{").replace("}}", "}").replace("'", "''") + "'"
    cases = lambda value: "CASE dst_id % 7 " + " ".join(f"WHEN {k} THEN {value(s)}" for k, s in enumerate(_STYLES)) + " END"
    text = cases(lambda s: f"replace(replace({quote(s[3])}, '{{r}}', concat('r', src_id)), '{{h}}', concat('h', partkey))")
    start = cases(lambda s: f"{s[2].count(chr(10)) + 1} + (n - 1) * {s[3].count(chr(10)) + 1} + 1")
    return f"""
, texts AS (SELECT project, dst_id, src_id, partkey, row_number() OVER (PARTITION BY project, dst_id ORDER BY {text}) AS n FROM uses)
, web AS (SELECT project, concat('src/routes', dst_id, {cases(lambda s: quote(s[1]))}) AS file, {cases(lambda s: quote(s[0]))} AS framework,
    concat('/r', src_id) AS path, CASE WHEN dst_id % 7 = 1 THEN concat('views.h', partkey) WHEN dst_id % 7 = 6 THEN 'handler' ELSE concat('h', partkey) END AS handler,
    CAST({start} AS INTEGER) AS line, {cases(lambda s: quote(_VERB[s[0]]))} AS method FROM texts
  UNION ALL SELECT project, concat('src/routes', dst_id, '.js'), 'express', concat('/r', src_id), 'x', CAST(n + 1 AS INTEGER), 'POST' FROM texts WHERE dst_id % 7 = 0)
"""


R.add(
    "extract_routes",
    "uses",
    lambda d: ex.extract_routes(_web(d)), _sql_web() + "SELECT project, file, method, path, handler, line, framework FROM web",
)
R.add(
    "route_summary",
    "uses",
    lambda d: ex.route_summary(ex.extract_routes(_web(d))),
    _sql_web() + "SELECT project, framework, count(*) AS routes FROM web GROUP BY ALL",
)


def _ignore_files(d):
    rules = "# build output\nbuild/\n!src/build/m5.test.ts\n/src/ui/m7.js\n*.test.ts\nm1?.js\n"
    return d["files"].select("project").distinct().withColumn("content", F.lit(rules))


R.add(
    "apply_ignore",
    "files",
    lambda d: apply_ignore(d["files"], _ignore_files(d), builtin_dirs=False).select(*KEYS),
    """SELECT project, path FROM files WHERE NOT starts_with(path, 'src/build/') AND path <> 'src/ui/m7.js' AND path NOT LIKE '%.test.ts'
       AND NOT regexp_matches(path, '/m1[^/]\\.js$')""",
)
R.add(
    "parse_change_log",
    "changes",
    lambda d: parse_change_log(
        d["changes"].select(
            "project",
            "seq",
            F.when(F.col("status") == "untracked", F.concat(F.lit("?? ./"), "path"))
            .when(F.col("status") == "renamed", F.concat(F.lit("R100\told.ts\t"), "path"))
            .when(F.col("status") == "added", F.concat(F.lit("A\t"), "path"))
            .when(F.col("status") == "deleted", F.concat(F.lit(" D "), "path"))
            .otherwise(F.concat(F.lit("T\t"), "path"))
            .alias("line"),
        )
    ),
    "SELECT project, seq, path, status FROM changes",
)

# ---- streaming twins ---------------------------------------------------------------------------

R.add(
    "change_bursts",
    "changes",
    lambda d: st.change_bursts(d["changes"], "1 hour"),
    """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM changes WINDOW w AS (PARTITION BY project ORDER BY ts, seq))
    , s AS (SELECT *, sum(fresh) OVER (PARTITION BY project ORDER BY ts, seq) AS burst FROM g)
    SELECT project, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS ended, count(*) AS changes, max(ts) AS last_at, arg_max(path, ts) AS last_path FROM s GROUP BY project, burst""",
)
R.add(
    "filter_ignored",
    "changes",
    lambda d: st.filter_ignored(d["changes"]).select("project", "path", "seq"),
    "SELECT project, path, seq FROM changes WHERE NOT contains(path, '/build/')",
)
R.add(
    "stale_stream",
    "changes meta files",
    lambda d: st.stale_stream(d["changes"], d["meta"]).select("project", "element", "path").distinct(),
    SQL_GLOBS + """SELECT e.project, e.path AS element, c.path FROM el_files e JOIN changes c ON c.project = e.project AND c.path = e.file
        AND (c.ref IS NULL OR e.git_commit IS NULL OR c.ref = e.git_commit)
      UNION SELECT e.project, e.path, c.path FROM gx e JOIN changes c ON c.project = e.project AND regexp_matches(c.path, e.rx)
        AND (c.ref IS NULL OR e.git_commit IS NULL OR c.ref = e.git_commit)""",
)


def _live_history(d):
    """The stream's operator, on a batch frame: the state of every element after all its writes."""
    return st.live_history(d["writes"].where("field = 'diagram'").select(*KEYS, "text", "seq", "written_at"))


R.add(
    "live_history",
    "writes",
    lambda d: _live_history(d),
    """SELECT project, path, CAST(age AS INTEGER) AS age, text FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY written_at DESC, seq DESC) AS age
       FROM writes WHERE field = 'diagram') x WHERE age <= 20""",
)

