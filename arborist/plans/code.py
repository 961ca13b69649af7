"""Queries over the import graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborist.functions.common import top_n
from arborist.functions.paths import is_test_file, language_of
from arborist.functions.rules import SUMMARY_LAYERS, VIOLATION_LAYERS
from arborist.operators import graph as g
from arborist.operators import traverse as t
from arborist.operators.diagrams import diagram_edges, undocumented_dependencies
from arborist.plans.docs import SQL_UNDOCUMENTED, sql_diagrams
from arborist.plans.registry import Registry

R = Registry()


# ---- SQL pieces of the checks ----------------------------------------------


def sql_layer(col: str, rules) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({col}), {chr(39)}{p}{chr(39)})' for p in pats)} THEN '{name}'"
        for name, pats in rules
    )
    return f"CASE {whens} END"


def sql_layer_index(expr: str) -> str:
    return f"list_position(['ui','api','service','data','infra'], {expr})"


SQL_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
SQL_BASE = "regexp_extract({0}, '([^/]*)$', 1)"
SQL_STEM = "regexp_replace({0}, '\\.[^.]+$', '')"
SQL_DEG = """
, fan_in AS (SELECT project, dst AS file, count(*) AS n FROM edges GROUP BY ALL)
, fan_out AS (SELECT project, src AS file, count(*) AS n FROM edges GROUP BY ALL)
, deg AS (SELECT project, file, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out
          FROM fan_in i FULL JOIN fan_out o USING (project, file))
"""
SQL_REACH = """
, reach(project, seed, node) AS (
    SELECT project, src, dst FROM edges
    UNION SELECT r.project, r.seed, e.dst FROM reach r JOIN edges e ON r.project = e.project AND r.node = e.src)
"""
SQL_HOT1 = SQL_DEG + """
, top1 AS (SELECT project, file AS dst FROM (
    SELECT *, row_number() OVER (PARTITION BY project ORDER BY fan_in DESC, file) AS rn FROM deg WHERE fan_in > 0) x WHERE rn = 1)
, pairs AS (SELECT DISTINCT e.project, e.src, t.dst FROM edges e JOIN top1 t ON e.project = t.project)
"""
SQL_CYCLES = """
, walks(project, start, node, path, closed) AS (
    SELECT project, src, dst, [src], false FROM edges WHERE dst > src
    UNION ALL
    SELECT w.project, w.start, e.dst, list_append(w.path, w.node), e.dst = w.start
    FROM walks w JOIN edges e ON w.project = e.project AND w.node = e.src
    WHERE NOT w.closed AND e.dst >= w.start AND NOT list_contains(list_append(w.path, w.node)[2:], e.dst))
, simple AS (SELECT DISTINCT project, path FROM walks WHERE closed)
, turned AS (SELECT project, path[i] AS a, list_concat(path[i + 1:], path[:i]) AS way FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM simple) x)
, least AS (SELECT project, way FROM (SELECT *, row_number() OVER (PARTITION BY project, a, way[1] ORDER BY len(way), way) AS rn FROM turned) x WHERE rn = 1)
, all_cycles AS (SELECT DISTINCT project, list_concat(way[list_position(way, list_min(way)):], way[:list_position(way, list_min(way)) - 1]) AS path FROM least)
"""


# ---- building the graph ------------------------------------------------------

R.add(
    "edges_from_uses",
    "edges",
    lambda d: d["edges"].select("project", "src", "dst", F.array_join("imports", ",").alias("names")),
    "SELECT project, src, dst, array_to_string(imports, ',') AS names FROM edges",
)
R.add(
    "language_of",
    "links files",
    lambda d: d["files"].select("project", "path").unionByName(d["links"].select("project", F.col("url").alias("path"))).select(
        "project", "path", language_of(F.col("path")).alias("language")
    ).where("language IS NOT NULL").groupBy("project", "language").agg(F.count(F.lit(1)).alias("n")),
    """SELECT project, CASE regexp_extract(path, '(\\.[^.]*)$', 1) WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' END AS language,
       count(*) AS n FROM (SELECT project, path FROM files UNION ALL SELECT project, url FROM links)
       WHERE regexp_extract(path, '(\\.[^.]*)$', 1) IN ('.js', '.ts') GROUP BY ALL""",
)
R.add(
    "language_stats",
    "source_files",
    lambda d: g.language_stats(d["source_files"]),
    """, per AS (SELECT project, CASE WHEN path LIKE '%.js' THEN 'javascript' ELSE 'typescript' END AS language, count(*) AS files,
          CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines, CAST(sum(strlen(content)) AS BIGINT) AS bytes
        FROM source_files GROUP BY ALL)
       SELECT project, language, files, lines, bytes,
          floor(bytes / sum(bytes) OVER (PARTITION BY project) * 10000 + 0.5) / 100 AS percentage FROM per""",
)


def _mixed_files(d):
    """Sources, and a text file in an unknown language beside some of them."""
    other = d["source_files"].where(F.col("path").contains("m1")).withColumn("path", F.regexp_replace("path", r"\.[^.]+$", ".md"))
    return d["source_files"].unionByName(other)


def _failed_files(d):
    return d["source_files"].where(F.col("path").contains("m7")).select("project", F.col("path").alias("file"))


R.add(
    "run_counts",
    "source_files docs",
    lambda d: g.run_counts(_mixed_files(d), _failed_files(d)),
    """, mixed AS (SELECT project, path FROM source_files UNION ALL SELECT project, regexp_replace(path, '\\.[^.]+$', '.md') FROM source_files WHERE contains(path, 'm1'))
    , bad AS (SELECT DISTINCT project, path FROM source_files WHERE contains(path, 'm7'))
    SELECT m.project, count(*) AS total_files, count(*) FILTER (WHERE NOT ends_with(m.path, '.md') AND b.path IS NULL) AS analyzed_files,
      count(*) FILTER (WHERE ends_with(m.path, '.md')) AS skipped_files, count(b.path) AS error_files
    FROM mixed m LEFT JOIN bad b ON b.project = m.project AND b.path = m.path GROUP BY m.project""",
)

# ---- degrees -------------------------------------------------------------------

R.add(
    "hotspots",
    "edges",
    lambda d: g.hotspots(d["edges"]),
    SQL_DEG + """SELECT project, file, fan_in, fan_out FROM (
      SELECT *, row_number() OVER (PARTITION BY project ORDER BY fan_in DESC, file) AS rn FROM deg WHERE fan_in > 0) x WHERE rn <= 20""",
)
R.add(
    "hotspot_importers",
    "edges",
    lambda d: g.hotspot_importers(d["edges"]),
    SQL_DEG + """, hot AS (SELECT project, file FROM (
      SELECT *, row_number() OVER (PARTITION BY project ORDER BY fan_in DESC, file) AS rn FROM deg WHERE fan_in > 0) x WHERE rn <= 20)
      SELECT e.project, e.dst AS file, e.src AS importer FROM edges e JOIN hot h ON e.project = h.project AND e.dst = h.file""",
)
R.add(
    "god_nodes",
    "edges",
    lambda d: g.god_nodes(d["edges"]),
    SQL_DEG + """SELECT project, file, fan_in, fan_out, fan_in + fan_out AS total_edges,
       CASE WHEN fan_in > 5 AND fan_out > 5 THEN 'bridge' WHEN fan_in > 5 THEN 'hub' ELSE 'normal' END AS role FROM (
      SELECT *, row_number() OVER (PARTITION BY project ORDER BY fan_in + fan_out DESC, file) AS rn FROM deg) x WHERE rn <= 10""",
)

# ---- modules ---------------------------------------------------------------------

SQL_MODULES = f"""
, modules AS (SELECT project, {SQL_DIR.format('file')} AS dir, count(*) AS n_files FROM node_files GROUP BY ALL HAVING count(*) >= 2)
, entries AS (SELECT DISTINCT project, {SQL_DIR.format('file')} AS dir, file FROM exports WHERE kind IN ('function', 'class'))
, deps AS (SELECT DISTINCT project, {SQL_DIR.format('src')} AS dir, dst FROM edges WHERE {SQL_DIR.format('src')} <> {SQL_DIR.format('dst')})
, flow AS (SELECT project, {SQL_DIR.format('src')} AS dir,
             count(*) FILTER (WHERE {SQL_DIR.format('src')} = {SQL_DIR.format('dst')}) AS i,
             count(*) FILTER (WHERE {SQL_DIR.format('src')} <> {SQL_DIR.format('dst')}) AS x FROM edges GROUP BY ALL)
"""
R.add(
    "module_boundaries",
    "edges node_files exports",
    lambda d: g.module_boundaries(d["node_files"], d["edges"], d["exports"]),
    SQL_MODULES + """SELECT project, dir, n_files, coalesce(i, 0) AS internal_edges, coalesce(x, 0) AS external_edges,
       coalesce(en, 0) AS entry_points, coalesce(dn, 0) AS dependencies,
       coalesce(floor(i / (i + x) * 100 + 0.5) / 100, 0.0) AS cohesion, regexp_extract(dir, '([^/]*)$', 1) AS name
     FROM modules LEFT JOIN flow USING (project, dir)
     LEFT JOIN (SELECT project, dir, count(*) AS en FROM entries GROUP BY ALL) e USING (project, dir)
     LEFT JOIN (SELECT project, dir, count(*) AS dn FROM deps GROUP BY ALL) dd USING (project, dir)""",
)
R.add(
    "module_entry_points",
    "edges node_files exports",
    lambda d: g.module_entry_points(d["node_files"], d["exports"]),
    SQL_MODULES + "SELECT project, dir, file FROM entries SEMI JOIN modules USING (project, dir)",
)
R.add(
    "module_dependencies",
    "edges node_files exports",
    lambda d: g.module_dependencies(d["node_files"], d["edges"]),
    SQL_MODULES + "SELECT project, dir, dst FROM deps SEMI JOIN modules USING (project, dir)",
)

# ---- exports and names --------------------------------------------------------------

R.add(
    "dead_exports",
    "edges exports",
    lambda d: g.dead_exports(d["exports"], d["edges"]).select("project", "file", "name", "kind"),
    """, used AS (SELECT project, dst AS file, unnest(imports) AS name FROM edges)
      SELECT project, file, name, kind FROM exports x WHERE name <> 'default'
      AND NOT EXISTS (SELECT 1 FROM used u WHERE u.project = x.project AND u.file = x.file AND u.name = x.name)""",
)
R.add(
    "public_api",
    "code_definitions",
    lambda d: g.public_api(d["code_definitions"]),
    """SELECT project, kind, name, file, count(*) OVER (PARTITION BY project, kind) AS kind_count
       FROM code_definitions WHERE exported""",
)
R.add(
    "complex_definitions",
    "code_definitions",
    lambda d: g.complex_definitions(d["code_definitions"]),
    """SELECT project, file, name, kind, end_line - line AS line_span, line, end_line FROM code_definitions
       WHERE end_line - line >= 50""",
)
R.add(
    "importers",
    "edges node_files",
    lambda d: g.importers(d["edges"], d["node_files"].where(is_test_file(F.col("file")))),
    """SELECT project, dst AS file, src AS importer FROM edges WHERE contains(lower(dst), 'test')""",
)
R.add(
    "imports_of",
    "edges node_files",
    lambda d: g.imports_of(d["edges"], d["node_files"]),
    "SELECT project, src AS file, dst AS imported, array_to_string(imports, ',') AS names FROM edges",
)
R.add(
    "resolve_names",
    "node_files",
    lambda d: g.resolve_names(["src/ui/M7.js", "src/core/m13", "m21", "data", "nowhere"], d["node_files"]),
    f""", ranked AS (SELECT project, term, file, CASE WHEN lower(file) = lower(term) THEN 0
         WHEN lower({SQL_STEM.format('file')}) = lower(term) THEN 1
         WHEN lower({SQL_STEM.format(SQL_BASE.format('file'))}) = lower(term) THEN 2
         WHEN contains(lower(file), lower(term)) THEN 3 END AS rank
       FROM node_files, (SELECT unnest(['src/ui/M7.js', 'src/core/m13', 'm21', 'data', 'nowhere']) AS term) q)
     SELECT project, term, file, rank FROM (
       SELECT *, row_number() OVER (PARTITION BY project, term ORDER BY rank, file) AS rn FROM ranked WHERE rank IS NOT NULL) x WHERE rn = 1""",
)
R.add(
    "test_files",
    "node_files",
    lambda d: d["node_files"].select(
        "project",
        "file",
        is_test_file(F.col("file")).alias("is_test"),
        is_test_file(F.col("file"), "src/*/m1*.js").alias("by_pattern"),
    ),
    """SELECT project, file, contains(lower(file), 'test') OR contains(lower(file), 'spec') AS is_test,
       regexp_matches(file, 'src/.*/m1.*.js') AS by_pattern FROM node_files""",
)

# ---- layers -------------------------------------------------------------------------

R.add(
    "classify_layers",
    "node_files",
    lambda d: g.classify_layers(d["node_files"]),
    f"SELECT project, file, {sql_layer('file', SUMMARY_LAYERS)} AS layer FROM node_files",
)
R.add(
    "layer_summary",
    "node_files",
    lambda d: g.layer_summary(d["node_files"]),
    f""", c AS (SELECT project, coalesce({sql_layer('file', SUMMARY_LAYERS)}, 'unclassified') AS layer, count(*) AS n FROM node_files GROUP BY ALL)
      SELECT p.project, CAST(r.position AS INTEGER) AS position, r.layer, coalesce(c.n, 0) AS files
      FROM (SELECT DISTINCT project FROM node_files) p
      CROSS JOIN (VALUES (1, 'ui'), (2, 'api'), (3, 'service'), (4, 'data'), (5, 'infra'), (6, 'unclassified')) r(position, layer)
      LEFT JOIN c ON c.project = p.project AND c.layer = r.layer
      WHERE r.layer <> 'unclassified' OR c.n > 0""",
)
SQL_VIOLATIONS = f"""
, lay AS (SELECT project, src, dst, {sql_layer('src', VIOLATION_LAYERS)} AS src_layer, {sql_layer('dst', VIOLATION_LAYERS)} AS dst_layer FROM edges)
, viol AS (SELECT *, {sql_layer_index('src_layer')} AS i, {sql_layer_index('dst_layer')} AS j FROM lay)
"""
R.add(
    "layer_violations",
    "edges",
    lambda d: g.layer_violations(d["edges"]),
    SQL_VIOLATIONS + """SELECT project, src, dst, src_layer, dst_layer,
      array_to_string(['ui','api','service','data','infra'][i + 1:j - 1], ',') AS skipped, CAST(j - i - 1 AS INTEGER) AS n_skipped
      FROM viol WHERE j > i + 1""",
)

# ---- reachability ---------------------------------------------------------------------

# Starts are chosen, as a caller would: the hotspots of each project, or what has changed.
_hot_seeds = lambda d: g.hotspots(d["edges"]).select("project", F.col("file").alias("seed"))
_changed_seeds = lambda d: d["changes"].select("project", F.col("path").alias("seed")).distinct()
SQL_HOT = SQL_DEG + """
, hot AS (SELECT project, file FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY fan_in DESC, file) AS rn FROM deg WHERE fan_in > 0) x WHERE rn <= 20)
"""

R.add(
    "transitive_dependencies",
    "edges",
    lambda d: t.transitive_dependencies(d["edges"], _hot_seeds(d)).select("project", "seed", "node"),
    SQL_HOT + SQL_REACH + "SELECT project, seed, node FROM reach SEMI JOIN hot ON hot.project = reach.project AND hot.file = reach.seed",
)
R.add(
    "transitive_dependents",
    "edges",
    lambda d: t.transitive_dependents(d["edges"], _hot_seeds(d)).select("project", "seed", "node"),
    SQL_HOT + SQL_REACH + "SELECT project, node AS seed, seed AS node FROM reach SEMI JOIN hot ON hot.project = reach.project AND hot.file = reach.node",
)
SQL_STEPS = """
, steps(project, seed, node, depth) AS (
    SELECT project, {seed}, {node}, 1 FROM edges
    UNION SELECT s.project, s.seed, e.{node}, s.depth + 1 FROM steps s JOIN edges e ON s.project = e.project AND s.node = e.{seed}
    WHERE s.depth < {bound})
, nearest AS (SELECT project, seed, node, min(depth) AS depth FROM steps GROUP BY ALL)
"""
R.add(
    "closure",
    "edges",
    lambda d: t.closure(d["edges"], _hot_seeds(d), "forward", 4).select("project", "seed", "node", "depth"),
    SQL_HOT + SQL_STEPS.format(seed="src", node="dst", bound=4) + "SELECT project, seed, node, depth FROM nearest SEMI JOIN hot ON hot.project = nearest.project AND hot.file = nearest.seed",
)
R.add(
    "closure_unbounded",
    "edges changes",
    lambda d: t.closure(d["edges"], _changed_seeds(d), "reverse").select("project", "seed", "node", "depth"),
    SQL_STEPS.format(seed="dst", node="src", bound=60) + "SELECT project, seed, node, depth FROM nearest SEMI JOIN changes ON changes.project = nearest.project AND changes.path = nearest.seed",
)
R.add(
    "change_impact",
    "edges changes",
    lambda d: t.change_impact(d["edges"], _changed_seeds(d)),
    SQL_STEPS.format(seed="dst", node="src", bound=60)
    + """SELECT n.project, n.path AS seed, count(depth) FILTER (WHERE depth = 1) AS direct,
      count(depth) FILTER (WHERE depth > 1) AS transitive, CAST(coalesce(max(depth), 0) AS INTEGER) AS impact_depth, count(depth) AS total_affected
      FROM (SELECT DISTINCT project, path FROM changes) n LEFT JOIN nearest x ON n.project = x.project AND n.path = x.seed AND x.node <> x.seed GROUP BY ALL""",
)
R.add(
    "change_set_impact",
    "edges changes",
    lambda d: t.change_set_impact(d["edges"], d["changes"].select("project", F.col("path").alias("seed"))),
    """, changed AS (SELECT DISTINCT project, path FROM changes)
    , hit(project, node) AS (SELECT project, path FROM changed
        UNION SELECT h.project, e.src FROM hit h JOIN edges e ON h.project = e.project AND h.node = e.dst)
    SELECT project, count(path) AS changed_files, count(*) - count(path) AS total_affected
    FROM (SELECT h.project, c.path FROM hit h LEFT JOIN changed c ON h.project = c.project AND h.node = c.path) x GROUP BY ALL""",
)
R.add(
    "affected_files",
    "edges changes",
    lambda d: t.affected_files(d["edges"], d["changes"].select("project", F.col("path").alias("file"))),
    """, hit(project, file, depth) AS (SELECT DISTINCT project, path, 0 FROM changes
        UNION SELECT h.project, e.src, h.depth + 1 FROM hit h JOIN edges e ON h.project = e.project AND h.file = e.dst WHERE h.depth < 5)
    SELECT project, file, min(depth) AS depth FROM hit GROUP BY ALL""",
)
R.add(
    "affected_tests",
    "edges changes",
    lambda d: t.affected_files(d["edges"], d["changes"].select("project", F.col("path").alias("file"))).where(
        is_test_file(F.col("file"))
    ),
    """, hit(project, file, depth) AS (SELECT DISTINCT project, path, 0 FROM changes
        UNION SELECT h.project, e.src, h.depth + 1 FROM hit h JOIN edges e ON h.project = e.project AND h.file = e.dst WHERE h.depth < 5)
    SELECT project, file, min(depth) AS depth FROM hit WHERE contains(lower(file), 'test') GROUP BY ALL""",
)


def _pairs(d):
    top = top_n(g.degrees(d["edges"]).where("fan_in > 0"), ["project"], [F.desc("fan_in"), F.asc("file")], 1)
    return d["edges"].select("project", "src").distinct().join(top.select("project", F.col("file").alias("dst")), "project")


R.add(
    "shortest_path",
    "edges",
    lambda d: t.shortest_path(d["edges"], _pairs(d), t.SMALL),
    SQL_HOT1 + """, paths(project, dst, node, path) AS (
      SELECT DISTINCT project, dst, dst, [dst] FROM pairs
      UNION ALL SELECT p.project, p.dst, e.src, list_prepend(e.src, p.path) FROM paths p JOIN edges e
        ON p.project = e.project AND p.node = e.dst WHERE NOT list_contains(p.path, e.src))
    SELECT project, src, dst, CAST(length AS INTEGER) AS length, array_to_string(path, ' > ') AS path FROM (
      SELECT a.project, a.src, a.dst, len(p.path) - 1 AS length, p.path,
        row_number() OVER (PARTITION BY a.project, a.src ORDER BY len(p.path), p.path) AS rn
      FROM pairs a JOIN paths p ON a.project = p.project AND a.dst = p.dst AND a.src = p.node) x WHERE rn = 1""",
)
R.add(
    "all_paths",
    "edges",
    lambda d: t.all_paths(d["edges"], _pairs(d)),
    SQL_HOT1 + """, paths(project, a, b, path) AS (
      SELECT DISTINCT project, src, src, [src] FROM (SELECT project, src FROM pairs UNION SELECT project, dst FROM pairs) s
      UNION ALL SELECT p.project, p.a, e.dst, list_append(p.path, e.dst) FROM paths p JOIN edges e
        ON p.project = e.project AND p.b = e.src WHERE NOT list_contains(p.path, e.dst) AND len(p.path) <= 5)
    , ahead AS (SELECT q.project, q.src, q.dst, false AS reversed, p.path FROM pairs q JOIN paths p
        ON q.project = p.project AND q.src = p.a AND q.dst = p.b)
    , back AS (SELECT q.project, q.src, q.dst, true AS reversed, p.path FROM pairs q JOIN paths p
        ON q.project = p.project AND q.src = p.b AND q.dst = p.a
        WHERE NOT EXISTS (SELECT 1 FROM ahead a WHERE a.project = q.project AND a.src = q.src AND a.dst = q.dst))
    SELECT project, src, dst, reversed, CAST(len(path) - 1 AS INTEGER) AS length, array_to_string(path, ' > ') AS path
    FROM (SELECT * FROM ahead UNION ALL SELECT * FROM back) x""",
)
R.add(
    "cycles",
    "edges",
    lambda d: t.cycles(d["edges"], t.SMALL),
    SQL_CYCLES + "SELECT project, CAST(len(path) AS INTEGER) AS length, array_to_string(path, ' > ') AS cycle FROM all_cycles",
)
R.add(
    "scc",
    "edges node_files",
    lambda d: t.scc(d["node_files"], d["edges"], t.SMALL),
    SQL_REACH + """, mutual AS (SELECT a.project, a.seed AS file, a.node AS other FROM reach a JOIN reach b
        ON a.project = b.project AND a.seed = b.node AND a.node = b.seed)
      SELECT n.project, n.file, coalesce(min(m.other), n.file) AS component FROM node_files n
      LEFT JOIN mutual m ON n.project = m.project AND n.file = m.file GROUP BY n.project, n.file""",
)
# ---- a project that grows with the data: a hub, and a component of most files ------------

SQL_GROWN = """
, fan AS (SELECT project, dst AS file, count(*) AS n FROM grown_edges GROUP BY ALL)
, target AS (SELECT project, file FROM fan ORDER BY n DESC, file LIMIT 20)
"""
R.add(
    "change_impact_grown",
    "grown_edges",
    lambda d: t.change_impact(
        d["grown_edges"], top_n(g.degrees(d["grown_edges"]), ["project"], [F.desc("fan_in"), F.asc("file")], 20).select("project", F.col("file").alias("seed"))
    ),
    SQL_GROWN + """, spread(seed, node, depth) AS (
        SELECT t.file, e.src, 1 FROM target t JOIN grown_edges e ON e.dst = t.file
        UNION SELECT s.seed, e.src, s.depth + 1 FROM spread s JOIN grown_edges e ON e.dst = s.node WHERE s.depth < 60
          AND NOT EXISTS (SELECT 1 FROM recurring.spread k WHERE k.seed = s.seed AND k.node = e.src))
      , least AS (SELECT seed, node, min(depth) AS depth FROM spread WHERE node <> seed GROUP BY ALL)
      SELECT 'grown' AS project, seed, count(*) FILTER (WHERE depth = 1) AS direct, count(*) FILTER (WHERE depth > 1) AS transitive,
        CAST(max(depth) AS INTEGER) AS impact_depth, count(*) AS total_affected FROM least GROUP BY seed""",
)
R.add(
    "scc_grown",
    "grown_files",
    lambda d: t.scc(d["grown_files"], d["grown_edges"]),
    """, down(file) AS (SELECT src FROM grown_edges WHERE src = 'src/api/m1.js' UNION SELECT e.dst FROM down d JOIN grown_edges e ON e.src = d.file)
    , up(file) AS (SELECT src FROM grown_edges WHERE src = 'src/api/m1.js' UNION SELECT e.src FROM up u JOIN grown_edges e ON e.dst = u.file)
    , core AS (SELECT file FROM down INTERSECT SELECT file FROM up)
    SELECT f.project, f.file, coalesce((SELECT min(file) FROM core WHERE EXISTS (SELECT 1 FROM core c WHERE c.file = f.file)), f.file) AS component FROM grown_files f""",
)
R.add(
    "guided_tour",
    "edges node_files",
    lambda d: t.guided_tour(d["node_files"], d["edges"], t.SMALL),
    SQL_DEG + SQL_REACH + """
    , looped AS (SELECT DISTINCT project, node FROM reach WHERE seed = node)
    , behind AS (SELECT project, node FROM looped UNION SELECT r.project, r.node FROM reach r JOIN looped l ON r.project = l.project AND r.seed = l.node)
    , clean AS (SELECT project, file FROM node_files n WHERE NOT EXISTS (SELECT 1 FROM behind b WHERE b.project = n.project AND b.node = n.file))
    , lev(project, file, depth) AS (
        SELECT c.project, c.file, 0 FROM clean c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project = c.project AND e.dst = c.file)
        UNION SELECT l.project, e.dst, l.depth + 1 FROM lev l JOIN edges e ON l.project = e.project AND l.file = e.src
          JOIN clean c ON c.project = e.project AND c.file = e.dst)
    , lv AS (SELECT project, file, max(depth) AS depth FROM lev GROUP BY ALL)
    SELECT lv.project, lv.file, lv.depth, CASE WHEN coalesce(d.fan_in, 0) = 0 AND coalesce(d.fan_out, 0) > 3
          THEN concat('entry point, connects to ', d.fan_out, ' modules')
        WHEN coalesce(d.fan_in, 0) = 0 THEN 'entry point'
        WHEN d.fan_out > 3 THEN concat('connects to ', d.fan_out, ' modules') ELSE 'dependency' END AS reason
    FROM lv LEFT JOIN deg d ON lv.project = d.project AND lv.file = d.file
    UNION ALL SELECT b.project, b.node, (SELECT coalesce(max(depth) + 1, 0) FROM lv WHERE lv.project = b.project), 'in cycle' FROM behind b""",
)
R.add("communities", "edges node_files", lambda d: t.communities(t.community_members(d["node_files"], d["edges"], small=t.SMALL), d["edges"]))
R.add(
    "fitness",
    "edges node_files fields",
    lambda d: g.fitness(
        d["node_files"], d["edges"], t.cycles(d["edges"], t.SMALL), undocumented_dependencies(d["edges"], diagram_edges(d["fields"]))
    ),
    SQL_DEG + SQL_VIOLATIONS + SQL_CYCLES + sql_diagrams("fields") + SQL_UNDOCUMENTED + f"""
    , modules AS (SELECT project, {SQL_DIR.format('file')} AS dir FROM node_files GROUP BY ALL HAVING count(*) >= 2)
    , flow AS (SELECT project, {SQL_DIR.format('src')} AS dir,
        count(*) FILTER (WHERE {SQL_DIR.format('src')} = {SQL_DIR.format('dst')}) AS i, count(*) AS t FROM edges GROUP BY ALL)
    , coh AS (SELECT project, sum(floor(coalesce(i / t, 0) * 100 + 0.5)) / (count(*) * 100) AS c
        FROM modules LEFT JOIN flow USING (project, dir) GROUP BY ALL)
    , n AS (SELECT p.project, coalesce(c, 1.0) AS c,
        coalesce((SELECT max(fan_in) FROM deg d WHERE d.project = p.project), 0) AS mf,
        (SELECT count(*) FROM viol v WHERE v.project = p.project AND j > i + 1) AS lv,
        (SELECT count(*) FROM all_cycles a WHERE a.project = p.project) AS cy,
        (SELECT count(*) FROM undoc u WHERE u.project = p.project) AS ud
        FROM (SELECT DISTINCT project FROM node_files) p LEFT JOIN coh ON p.project = coh.project)
    , q AS (SELECT project, greatest(0, 20 - 2 * cy) AS circular_deps, CAST(floor(c * 20 + 0.5) AS BIGINT) AS cohesion,
        greatest(0, 20 - 2 * greatest(0, mf - 5)) AS coupling, greatest(0, 20 - lv) AS layer_purity, greatest(0, 20 - ud) AS doc_accuracy,
        cy AS cycles_found, CAST(floor(c * 100 + 0.5) AS BIGINT) AS avg_cohesion_pct, mf AS max_fan_in, lv AS layer_violation_count,
        ud AS undocumented_deps FROM n)
    SELECT *, least(100, circular_deps + cohesion + coupling + layer_purity + doc_accuracy) AS overall FROM q""",
)
