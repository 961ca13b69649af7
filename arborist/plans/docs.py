"""Queries over documentation: diagrams, references, trees, metrics, scores, histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborist.functions.rules import BROAD_EDGE, CLASSDEF_PALETTE, DIRECTIVE_LINE, GRAPH_DECLARATION, NODE_LINE, RESERVED_WORDS, SKIP_LINE, STRICT_EDGE
from arborist.functions.text import sql_lane_digest
from arborist.operators import diagrams as dg
from arborist.operators import docs as dc
from arborist.operators import history as hs
from arborist.operators import quality as ql
from arborist.operators import traverse as tv
from arborist.operators.coverage import orphaned_sources
from arborist.plans.registry import Registry
from arborist.sources import sinks

R = Registry()
KEYS = ["project", "path"]

# ---- SQL pieces of the checks ---------------------------------------------------


def sql_diagrams(table: str, p: str = "") -> str:
    """CTEs {p}dlines, {p}dparsed, {p}dnodes, {p}dedges over a `fields`-like table."""
    ex = lambda g: (
        f"CASE WHEN regexp_matches(line, '{STRICT_EDGE}') THEN regexp_extract(line, '{STRICT_EDGE}', {g}) "
        f"WHEN regexp_matches(line, '{BROAD_EDGE}') THEN regexp_extract(line, '{BROAD_EDGE}', {g}) END"
    )
    return f"""
, {p}dlines AS (SELECT project, path, CAST(i AS INTEGER) AS line_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line
    FROM (SELECT project, path, unnest(string_split(text, chr(10))) AS raw,
            generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {table} WHERE field = 'diagram') s
    WHERE regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> '' AND NOT starts_with(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '%%'))
, {p}dparsed AS (SELECT project, path, replace(replace({ex(1)}, '"', ''), '''', '') AS src, {ex(2)} AS arrow,
      replace(replace({ex(3)}, '"', ''), '''', '') AS dst,
      replace(replace(regexp_extract(line, '{NODE_LINE}', 1), '"', ''), '''', '') AS single
    FROM {p}dlines WHERE NOT regexp_matches(line, '{SKIP_LINE}'))
, {p}dedges AS (SELECT DISTINCT project, path, src, arrow, dst FROM {p}dparsed WHERE arrow IS NOT NULL)
, {p}dnodes AS (SELECT project, path, src AS node FROM {p}dedges UNION SELECT project, path, dst FROM {p}dedges
    UNION SELECT project, path, single FROM {p}dparsed WHERE arrow IS NULL AND single <> '')
"""


SQL_REFS = """
, refs AS (SELECT DISTINCT project, path AS source_class, unnest(regexp_extract_all(text, '@([\\w-]+)', 1)) AS target_class
    FROM fields WHERE field = 'diagram')
"""
SQL_TYPES = """
, drawn AS (SELECT DISTINCT project, path FROM fields WHERE field = 'diagram')
, kids AS (SELECT e.project, regexp_replace(e.path, '/[^/]*$', '') AS path, count(*) AS children, count(d.path) AS covered
    FROM elements e LEFT JOIN drawn d ON e.project = d.project AND e.path = d.path WHERE contains(e.path, '/') GROUP BY ALL)
"""

# ---- diagrams ---------------------------------------------------------------------

R.add(
    "diagram_edges",
    "fields",
    lambda d: dg.diagram_edges(d["fields"]),
    sql_diagrams("fields") + "SELECT * FROM dedges",
)
R.add(
    "diagram_nodes",
    "fields",
    lambda d: dg.diagram_nodes(d["fields"]),
    sql_diagrams("fields") + "SELECT * FROM dnodes",
)


def _redrawn(d):
    text = F.when(F.col("path").startswith("fr"), F.replace("text", F.lit(" --> "), F.lit(" ==> "))).otherwise(F.col("text"))
    return d["fields"].where(~F.col("path").startswith("es")).withColumn("text", text)


R.add(
    "diagram_diff",
    "fields",
    lambda d: dg.diagram_diff(d["fields"], _redrawn(d)),
    """, redrawn AS (SELECT project, path, field, CASE WHEN starts_with(path, 'fr') THEN replace(text, ' --> ', ' ==> ') ELSE text END AS text
        FROM fields WHERE NOT starts_with(path, 'es'))"""
    + sql_diagrams("fields", "a_")
    + sql_diagrams("redrawn", "b_")
    + """, a AS (SELECT project, path, 'node' AS what, node AS item FROM a_dnodes UNION ALL SELECT project, path, 'edge', concat(src, ' ', arrow, ' ', dst) FROM a_dedges)
    , b AS (SELECT project, path, 'node' AS what, node AS item FROM b_dnodes UNION ALL SELECT project, path, 'edge', concat(src, ' ', arrow, ' ', dst) FROM b_dedges)
    SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x
    UNION ALL SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y""",
)
R.add(
    "line_diff",
    "snapshot_old snapshot_new",
    lambda d: dg.line_diff(d["snapshot_old"].withColumnRenamed("content", "text"), d["snapshot_new"].withColumnRenamed("content", "text")),
    """, o AS (SELECT project, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM snapshot_old)
    , n AS (SELECT project, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM snapshot_new)
    , b AS (SELECT project, path, i, coalesce(o.line, '') AS old, coalesce(n.line, '') AS new FROM o FULL JOIN n USING (project, path, i))
    SELECT project, path, CAST(i AS INTEGER) AS line_no, '-' AS sign, old AS line FROM b WHERE old <> new AND old <> ''
    UNION ALL SELECT project, path, CAST(i AS INTEGER), '+', new FROM b WHERE old <> new AND new <> ''""",
)
R.add(
    "explode_flows",
    "flows",
    lambda d: dg.explode_flows(d["flows"]),
    """SELECT project, path, name, CAST(i - 1 AS INTEGER) AS step, CASE WHEN NOT contains(w, '->') THEN w END AS node,
       CASE WHEN contains(w, '->') THEN split_part(w, '->', 1) END AS src, CASE WHEN contains(w, '->') THEN split_part(w, '->', 2) END AS dst
       FROM (SELECT project, path, name, unnest(steps) AS w, generate_subscripts(steps, 1) AS i FROM flows) x""",
)
R.add("flowchart_edges", "fields", lambda d: dg.flowchart_edges(d["fields"]))
R.add("flowchart_nodes", "fields", lambda d: dg.flowchart_nodes(d["fields"]))
R.add("flowchart_directions", "fields", lambda d: dg.flowchart_directions(d["fields"]),
    """SELECT project, path, CASE WHEN starts_with(text, 'flowchart TD') THEN 'TB' ELSE 'LR' END AS direction FROM fields WHERE field = 'diagram'""")


def _sql_unbalanced(expr: str) -> str:
    n = lambda c: f"(length({expr}) - length(replace({expr}, '{c}', '')))"
    return f"({n('[')} <> {n(']')} OR {n('(')} <> {n(')')} OR {n('{')} <> {n('}')})"


_SQL_PALETTE = ", ".join(f"('{n}', '{a}', '{c}')" for n, attrs in CLASSDEF_PALETTE.items() for a, c in attrs.items())
SQL_LINT = (
    sql_diagrams("fields")
    + SQL_REFS
    + f"""
, bare AS (SELECT *, regexp_replace(concat(line, CASE WHEN (length(line) - length(replace(line, '"', ''))) % 2 = 1 THEN '"' ELSE '' END),
      '"[^"]*"', '', 'g') AS unquoted, regexp_extract_all(concat(line, CASE WHEN (length(line) - length(replace(line, '"', ''))) % 2 = 1 THEN '"' ELSE '' END),
      '"([^"]*)"', 1) AS quoted FROM dlines)
, marks AS (SELECT *, starts_with(line, 'classDef ') AS cd,
      list_concat(quoted, flatten(list_transform(list_filter(regexp_split_to_array(regexp_replace(concat(line,
        CASE WHEN (length(line) - length(replace(line, '"', ''))) % 2 = 1 THEN '"' ELSE '' END), '"[^"]*"', chr(1), 'g'), chr(1)), lambda x: x <> ''),
        lambda x: regexp_extract_all(x, '[\\[(\\{{]([^\\]\\}})]*)[\\]\\}})]', 1)))) AS labels FROM bare)
, tops AS (SELECT DISTINCT project, path FROM elements WHERE NOT contains(path, '/'))
, lint AS (
    SELECT project, path, 1 AS line, 'error' AS level, 'graph-declaration' AS rule, 'Diagram must start with a graph/flowchart direction declaration' AS message
      FROM (SELECT DISTINCT project, path FROM fields WHERE field = 'diagram') f
      WHERE NOT EXISTS (SELECT 1 FROM dlines l WHERE l.project = f.project AND l.path = f.path AND regexp_matches(l.line, '{GRAPH_DECLARATION}')
        AND l.line_no = (SELECT min(m.line_no) FROM dlines m WHERE m.project = f.project AND m.path = f.path))
    UNION ALL SELECT project, path, line_no, 'error', 'balanced-brackets', concat('Unbalanced brackets on line: ', line) FROM bare WHERE {_sql_unbalanced('unquoted')}
    UNION ALL SELECT project, path, line_no, 'error', 'reserved-word', concat('Node ID "', id, '" is a reserved keyword') FROM (SELECT project, path, line_no,
        unnest(regexp_extract_all(regexp_replace(unquoted, '', '', 'g'), '\\b(\\w+)\\s*[\\[(\\{{]', 1)) AS id FROM bare WHERE NOT starts_with(line, 'classDef ')) r
      WHERE list_contains({RESERVED_WORDS}, lower(id))
    UNION ALL SELECT project, path, line_no, 'warning', 'special-char-label', concat('Label contains @: ', line) FROM marks
      WHERE NOT cd AND len(list_filter(labels, lambda x: contains(x, '@'))) > 0
    UNION ALL SELECT project, path, line_no, 'warning', 'special-char-label', concat('Label contains <>: ', line) FROM marks
      WHERE NOT cd AND len(list_filter(labels, lambda x: contains(x, '<') AND contains(x, '>'))) > 0
    UNION ALL SELECT project, path, line_no, 'warning', 'edge-label', concat('Edge without label: ', line) FROM dlines WHERE regexp_matches(line, '-->|==>|-.->')
      AND NOT regexp_matches(line, '{DIRECTIVE_LINE}') AND NOT regexp_matches(line, '\\|.*?\\|')
    UNION ALL SELECT project, path, line_no, 'warning', 'classdef-name', concat('Unknown classDef name ', regexp_extract(line, '(?i)^classDef\\s+(\\S+)', 1)) FROM dlines
      WHERE regexp_matches(line, '(?i)^classDef\\s+(\\S+)\\s+(.+)$') AND regexp_extract(line, '(?i)^classDef\\s+(\\S+)', 1) NOT IN ('external', 'concern', 'entry', 'store')
    UNION ALL SELECT c.project, c.path, c.line_no, 'warning', 'classdef-color', concat('classDef "', c.name, '" has ', regexp_replace(c.pair, '\\s', '', 'g'), ', expected ', p.color)
      FROM (SELECT project, path, line_no, regexp_extract(line, '(?i)^classDef\\s+(\\S+)\\s+(.+)$', 1) AS name,
              unnest(regexp_extract_all(regexp_extract(line, '(?i)^classDef\\s+(\\S+)\\s+(.+)$', 2), '(\\w+\\s*:\\s*#[0-9a-fA-F]{{3,8}})', 1)) AS pair FROM dlines) c
      JOIN (VALUES {_SQL_PALETTE}) p(name, attr, color) ON p.name = c.name AND p.attr = regexp_extract(c.pair, '^(\\w+)', 1)
      WHERE p.color <> lower(regexp_extract(c.pair, '(#.*)$', 1))
    UNION ALL SELECT project, path, NULL, 'warning', 'node-count', concat(count(*), ' nodes (recommended: 5-15)') FROM dnodes GROUP BY project, path HAVING count(*) < 3 OR count(*) > 15
    UNION ALL SELECT project, source_class, NULL, 'error', 'ref-self', concat('Diagram references its own class: @', target_class) FROM refs WHERE source_class = target_class
    UNION ALL SELECT project, source_class, NULL, 'error', 'ref-exists', concat('No such perspective: @', target_class) FROM refs r WHERE source_class <> target_class
      AND NOT EXISTS (SELECT 1 FROM tops e WHERE e.project = r.project AND e.path = r.target_class)
    UNION ALL SELECT project, source_class, NULL, 'warning', 'potential-circular-ref', concat('Check for a circular dependency with @', target_class) FROM refs r
      WHERE NOT contains(source_class, '/') AND EXISTS (SELECT 1 FROM tops e WHERE e.project = r.project AND e.path = r.target_class)
    UNION ALL SELECT project, source_class, CAST(NULL AS INTEGER), 'warning', 'perspective-cross-ref', concat('References other perspectives: ', count(*)) FROM refs r
      WHERE NOT contains(source_class, '/') AND source_class NOT IN ('overall-architecture', 'architecture')
      AND EXISTS (SELECT 1 FROM tops e WHERE e.project = r.project AND e.path = r.target_class) GROUP BY project, source_class)
, errors AS (SELECT DISTINCT project, path FROM lint WHERE rule IN ('graph-declaration', 'balanced-brackets', 'reserved-word', 'ref-self', 'ref-exists'))
"""
)
_lint = lambda d: dg.lint_diagrams(d["fields"], d["elements"])
R.add(
    "lint_diagrams",
    "fields elements",
    lambda d: _lint(d).select(*KEYS, "line", "level", "rule", "message"),
    SQL_LINT + "SELECT project, path, CAST(line AS INTEGER) AS line, level, rule, message FROM lint",
)
#: A sequence diagram of every element, written in SQL that both engines read; n varies what it has.
_SEQUENCE = (
    "CASE WHEN n % 11 = 0 THEN ' ' ELSE concat(CASE WHEN n % 4 = 0 THEN '' ELSE concat('@startuml', chr(10)) END, 'participant A', chr(10),"
    " CASE WHEN n % 3 = 0 THEN concat('Actor B', chr(10)) ELSE '' END, CASE WHEN n % 2 = 0 THEN concat('A -> B: hi', chr(10)) ELSE concat('// A -> B', chr(10)) END,"
    " CASE WHEN n % 5 = 0 THEN concat('alt x', chr(10), 'loop y', chr(10)) ELSE '' END, CASE WHEN n % 7 = 0 THEN concat('  end', chr(10)) ELSE '' END,"
    " CASE WHEN n % 6 = 0 THEN '' ELSE '@enduml' END) END"
)


def _sequences(d):
    numbered = d["elements"].select(*KEYS, (F.length("path") + F.length("project")).alias("n"))
    return numbered.select(*KEYS, F.lit("diagram").alias("field"), F.expr(_SEQUENCE).alias("text"), F.lit("sequence").alias("format"))


R.add(
    "lint_sequence_diagrams",
    "elements",
    lambda d: dg.lint_by_format(_sequences(d), d["elements"]).select(*KEYS, "level", "rule", "message"),
    f""", seq AS (SELECT project, path, {_SEQUENCE} AS text FROM (SELECT project, path, length(path) + length(project) AS n FROM elements) e)
    , ln AS (SELECT project, path, trim(text) = '' AS blank, lower(text) AS low, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM seq)
    , facts AS (SELECT *, len(list_filter(l, lambda x: regexp_matches(x, '(?i)^(participant|actor|boundary|control|entity|database|collections|component)\\s+'))) AS people,
        len(list_filter(l, lambda x: contains(x, '->') AND NOT starts_with(x, '//'))) AS messages,
        list_reduce(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^(alt|loop)\\b') THEN 1 WHEN regexp_matches(x, '^end\\b') THEN -1 ELSE 0 END),
          lambda a, x: greatest(a + x, 0), 0) AS depth FROM ln)
    SELECT project, path, 'error' AS level, 'empty-diagram' AS rule, 'Diagram is empty.' AS message FROM facts WHERE blank
    UNION ALL SELECT project, path, 'error', 'missing-startuml', 'Missing @startuml tag.' FROM facts WHERE NOT blank AND NOT contains(low, '@startuml')
    UNION ALL SELECT project, path, 'error', 'missing-enduml', 'Missing @enduml tag.' FROM facts WHERE NOT blank AND NOT contains(low, '@enduml')
    UNION ALL SELECT project, path, 'warning', 'few-participants', 'Only 1 participant(s).' FROM facts WHERE NOT blank AND people = 1
    UNION ALL SELECT project, path, 'warning', 'no-messages', 'No messages found.' FROM facts WHERE NOT blank AND people > 0 AND messages = 0
    UNION ALL SELECT project, path, 'warning', 'unbalanced-blocks', concat('Unbalanced block structure (depth: ', depth, ')') FROM facts WHERE NOT blank AND depth <> 0""",
)
R.add("repair_diagrams", "fields", lambda d: dg.repair_diagrams(d["fields"]).select(*KEYS, "fixed", "changed"))
R.add("repair_report", "fields elements", lambda d: dg.repair_report(_lint(d)).select(*KEYS, "line", "rule", "message", "fixed"))
SQL_UNDOCUMENTED = """
, undoc AS (SELECT DISTINCT project, regexp_replace(regexp_extract(src, '([^/]*)$', 1), '\\.[^.]+$', '') AS src,
       regexp_replace(regexp_extract(dst, '([^/]*)$', 1), '\\.[^.]+$', '') AS dst FROM edges
     EXCEPT SELECT project, src, dst FROM dedges WHERE arrow = '-->')
"""
R.add(
    "undocumented_dependencies",
    "edges fields",
    lambda d: dg.undocumented_dependencies(d["edges"], dg.diagram_edges(d["fields"])),
    sql_diagrams("fields") + SQL_UNDOCUMENTED + "SELECT * FROM undoc",
)
R.add(
    "dependency_counts",
    "edges fields",
    lambda d: dg.dependency_counts(d["edges"], dg.diagram_edges(d["fields"])),
    sql_diagrams("fields")
    + """, act AS (SELECT DISTINCT project, regexp_replace(regexp_extract(src, '([^/]*)$', 1), '\\.[^.]+$', '') AS src,
       regexp_replace(regexp_extract(dst, '([^/]*)$', 1), '\\.[^.]+$', '') AS dst FROM edges)
     , doc AS (SELECT DISTINCT project, src, arrow, dst FROM dedges)
     SELECT a.project, (SELECT count(*) FROM doc d WHERE d.project = a.project) AS documented_edges, count(*) AS actual_edges,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM doc d WHERE d.project = a.project AND d.src = a.src AND d.dst = a.dst AND arrow = '-->')) AS missing_edges
     FROM act a GROUP BY a.project""",
)
R.add(
    "undocumented_diagram_nodes",
    "fields elements",
    lambda d: dg.undocumented_diagram_nodes(d["fields"], d["elements"]),
    sql_diagrams("fields")
    + """SELECT project, path, node, CASE WHEN node IN ('en', 'fr', 'de', 'es') THEN concat('Docs in ', node) WHEN node = 'gone' THEN 'see @missing'
        WHEN node = 'self' THEN 'see @fr' WHEN node = 'a' AND ends_with(path, 'good') THEN 'Input' WHEN node = 'b' AND ends_with(path, 'good') THEN 'Output'
        WHEN node = 'e' THEN 'A <b> c' ELSE node END AS label
      FROM dnodes n WHERE len(string_split(path, '/')) <= 2 AND NOT starts_with(node, '@') AND NOT starts_with(node, '__')
      AND NOT EXISTS (SELECT 1 FROM elements e WHERE e.project = n.project AND e.path = concat(n.path, '/', n.node))""",
)

# ---- references -------------------------------------------------------------------

R.add(
    "extract_refs",
    "fields",
    lambda d: dg.extract_refs(d["fields"]).select("project", "source_class", "target_class", "node_id"),
    SQL_REFS + "SELECT project, source_class, target_class, concat('@', target_class) AS node_id FROM refs",
)
R.add(
    "ref_graph",
    "fields",
    lambda d: dc.ref_graph(d["fields"]),
    SQL_REFS + "SELECT project, source_class, target_class, concat('@', target_class) AS node_id FROM refs WHERE NOT contains(source_class, '/')",
)
_SQL_CHECK = """
SELECT r.project, r.source_class, r.target_class,
  CASE WHEN r.source_class = r.target_class THEN 'ref-self' WHEN e.path IS NULL THEN 'ref-exists' ELSE 'ok' END AS status,
  (r.source_class <> r.target_class AND e.path IS NOT NULL AND EXISTS (SELECT 1 FROM refs b WHERE b.project = r.project
     AND b.source_class = r.target_class AND b.target_class = r.source_class)) AS mutual
FROM refs r LEFT JOIN (SELECT DISTINCT project, path FROM elements {0}) e ON e.project = r.project AND e.path = r.target_class
"""
R.add(
    "check_refs",
    "fields elements",
    lambda d: dg.check_refs(dg.extract_refs(d["fields"]), d["elements"]),
    SQL_REFS + _SQL_CHECK.format("WHERE NOT contains(path, '/')"),
)
R.add(
    "check_refs_all",
    "fields elements",
    lambda d: dg.check_refs(dg.extract_refs(d["fields"]), d["elements"], "all"),
    SQL_REFS + _SQL_CHECK.format(""),
)
R.add(
    "outgoing_refs",
    "fields",
    lambda d: dc.outgoing_refs(d["fields"]),
    sql_diagrams("fields") + SQL_REFS
    + """SELECT project, source_class AS path, target_class AS target FROM refs
      UNION SELECT project, concat(path, '/', src), dst FROM dedges WHERE arrow = '-->'""",
)
R.add(
    "incoming_refs",
    "fields",
    lambda d: dc.incoming_refs(d["fields"]),
    sql_diagrams("fields") + SQL_REFS
    + """SELECT project, target_class AS path, source_class AS source FROM refs WHERE NOT contains(source_class, '/') AND source_class <> target_class
      UNION SELECT project, concat(path, '/', dst), src FROM dedges WHERE arrow = '-->'""",
)
R.add(
    "resolve_ref_chains",
    "fields elements",
    lambda d: tv.resolve_ref_chains(dg.extract_refs(d["fields"]), d["elements"]),
    SQL_REFS + """
    , known AS (SELECT DISTINCT project, path FROM elements)
    , hop AS (SELECT r.project, r.source_class AS a, r.target_class AS b, k.path IS NOT NULL AS live FROM refs r
        LEFT JOIN known k ON k.project = r.project AND k.path = r.target_class)
    , out_live AS (SELECT DISTINCT project, a FROM hop WHERE live)
    , walk(project, start, node, chain, type) AS (
        SELECT h.project, h.a, h.a, [h.a], 'open' FROM (SELECT DISTINCT h.project, h.a FROM hop h JOIN known k ON k.project = h.project AND k.path = h.a) h
        UNION ALL SELECT w.project, w.start, h.b, list_append(w.chain, h.b),
          CASE WHEN NOT h.live THEN 'broken' WHEN list_contains(w.chain, h.b) THEN 'cycle' ELSE 'open' END
        FROM walk w JOIN hop h ON w.project = h.project AND w.node = h.a WHERE w.type = 'open')
    , ends AS (SELECT project, start, type, node AS "end", chain FROM walk WHERE type <> 'open'
        UNION ALL SELECT w.project, w.start, 'resolved', w.node, w.chain FROM walk w
          WHERE w.type = 'open' AND len(w.chain) > 1 AND NOT EXISTS (SELECT 1 FROM out_live o WHERE o.project = w.project AND o.a = w.node))
    SELECT project, start, type, "end", CAST(length AS INTEGER) AS length, chain FROM (
      SELECT project, start, type, "end", len(chain) AS length, array_to_string(chain, ' > ') AS chain,
        row_number() OVER (PARTITION BY project, start, type, "end" ORDER BY len(chain), array_to_string(chain, ' > ')) AS rn FROM ends) x WHERE rn = 1""",
)

# ---- elements -----------------------------------------------------------------------

R.add(
    "element_types",
    "elements fields",
    lambda d: dc.element_types(d["elements"], d["fields"]),
    SQL_TYPES + """SELECT e.project, e.path, CASE WHEN NOT contains(e.path, '/') THEN 'perspective' WHEN d.path IS NOT NULL THEN 'group' ELSE 'leaf' END AS type
      FROM elements e LEFT JOIN drawn d ON e.project = d.project AND e.path = d.path""",
)
R.add(
    "tag_filter",
    "meta",
    lambda d: dc.tag_filter(d["meta"], ["TOPIC", "good"]).select(*KEYS),
    "SELECT project, path FROM meta WHERE list_contains(list_transform(tags, lambda x: lower(x)), 'topic') AND list_contains(list_transform(tags, lambda x: lower(x)), 'good')",
)
R.add(
    "split_tags",
    "docs",
    lambda d: dc.split_tags(
        d["docs"].select(
            "project",
            F.concat("persp", F.lit("/doc"), F.col("doc_id")).alias("path"),
            F.concat(F.lit('["'), "persp", F.lit('", '), F.col("doc_id"), F.lit(', {"e": "x, y"}, "'), "topic", F.lit('"]')).alias("tags_json"),
        )
    ).select(*KEYS, F.array_join("tags", ",").alias("tags"), "corrupted"),
    "SELECT project, concat(persp, '/doc', doc_id) AS path, concat(persp, ',', topic) AS tags, CAST(2 AS INTEGER) AS corrupted FROM docs",
)
R.add(
    "element_tree",
    "elements fields",
    lambda d: dc.element_tree(d["elements"], d["fields"]).withColumn("sort_key", F.array_join("sort_key", "/")),
    SQL_TYPES + """, c AS (SELECT project, path, len(string_split(path, '/')) - 1 AS depth, regexp_extract(path, '([^/]*)$', 1) AS name,
         CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM elements)
      , t AS (SELECT project, path, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS s FROM fields WHERE field = 'description' AND regexp_matches(text, '\\S'))
      SELECT c.project, c.path, CAST(depth AS INTEGER) AS depth, name, name = max(name) OVER (PARTITION BY c.project, parent) AS is_last,
        CASE WHEN length(s) > 60 THEN concat(substring(s, 1, 57), '...') ELSE s END AS description, d.path IS NOT NULL AS has_diagram, c.path AS sort_key
      FROM c LEFT JOIN t ON c.project = t.project AND c.path = t.path LEFT JOIN drawn d ON c.project = d.project AND c.path = d.path""",
)
R.add(
    "children_coverage",
    "elements fields",
    lambda d: dc.children_coverage(d["elements"], d["fields"]),
    SQL_TYPES + "SELECT * FROM kids",
)
R.add(
    "field_stats",
    "fields",
    lambda d: dc.field_stats(d["fields"]),
    """SELECT project, path, field, regexp_matches(text, '\\S') AS present,
       CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words FROM fields""",
)
R.add(
    "element_metrics",
    "elements fields",
    lambda d: dc.element_metrics(d["elements"], d["fields"]),
    sql_diagrams("fields") + SQL_TYPES + """
      , w AS (SELECT project, path, count(*) AS present, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words
          FROM fields WHERE regexp_matches(text, '\\S') GROUP BY ALL)
      , n AS (SELECT project, path, count(*) AS n FROM dnodes GROUP BY ALL), m AS (SELECT project, path, count(*) AS m FROM dedges GROUP BY ALL)
      SELECT project, path, coalesce(words, 0) AS words, CAST(floor(coalesce(present, 0) / 7 * 100 + 0.5) AS BIGINT) AS coverage_pct,
        coalesce(n, 0) AS diagram_nodes, coalesce(m, 0) AS diagram_edges, CASE WHEN n > 15 THEN 'high' WHEN n > 8 THEN 'medium' ELSE 'low' END AS complexity,
        coalesce(children, 0) AS children
      FROM elements LEFT JOIN w USING (project, path) LEFT JOIN n USING (project, path) LEFT JOIN m USING (project, path) LEFT JOIN kids USING (project, path)""",
)
R.add(
    "signature",
    "elements",
    lambda d: dc.signature(d["elements"]),
    f"""SELECT project, concat('sha256:', {sql_lane_digest('path')}) AS signature, count(*) AS element_count,
       count(*) FILTER (WHERE NOT contains(path, '/')) AS perspectives FROM elements GROUP BY project""",
)
_stored = lambda d: dc.signature(d["elements"].where("path NOT LIKE 'es%'")).select("project", "signature")
R.add(
    "check_signature",
    "elements",
    lambda d: dc.check_signature(d["elements"], _stored(d)),
    f""", cur AS (SELECT project, concat('sha256:', {sql_lane_digest('path')}) AS signature FROM elements GROUP BY project)
    , sto AS (SELECT project, concat('sha256:', {sql_lane_digest('path')}) AS stored FROM elements WHERE NOT starts_with(path, 'es') GROUP BY project)
    SELECT project, signature, stored, CASE WHEN stored IS NULL THEN 'unset' WHEN stored = signature THEN 'ok' ELSE 'stale' END AS state FROM cur LEFT JOIN sto USING (project)""",
)
R.add(
    "project_summary",
    "elements writes",
    lambda d: dc.project_summary(d["elements"], d["writes"]),
    """, e AS (SELECT project, count(*) FILTER (WHERE NOT contains(path, '/')) AS perspectives, count(*) AS elements FROM elements GROUP BY project)
    , w AS (SELECT project, max(written_at) AS last_update, count(*) AS updates FROM writes GROUP BY project)
    SELECT project, coalesce(perspectives, 0) AS perspectives, coalesce(elements, 0) AS elements, last_update, coalesce(updates, 0) AS updates
    FROM e FULL JOIN w USING (project)""",
)
SQL_NETWORK = sql_diagrams("(SELECT * FROM fields WHERE NOT contains(path, '/')) top") + """
, net AS (
    SELECT DISTINCT project, concat(path, '/', src) AS src, concat(path, '/', dst) AS dst, 'drawn' AS kind FROM dedges
    UNION ALL SELECT project, path, concat(path, '/', node), 'contains' FROM dnodes
    UNION ALL SELECT n.project, concat(n.path, '/', n.node), concat(o.path, '/', n.node), 'shared' FROM dnodes n
      JOIN dnodes o ON o.project = n.project AND o.node = n.node AND o.path <> n.path
      JOIN elements e ON e.project = n.project AND e.path = concat(o.path, '/', n.node))
"""
R.add(
    "network_graph",
    "elements fields",
    lambda d: dc.network_graph(d["elements"], d["fields"]),
    SQL_NETWORK + "SELECT * FROM net",
)
R.add(
    "network_degrees",
    "elements fields",
    lambda d: dc.network_degrees(dc.network_graph(d["elements"], d["fields"])),
    SQL_NETWORK + """SELECT project, node, count(*) AS connections FROM (SELECT project, src AS node FROM net WHERE kind <> 'shared'
      UNION ALL SELECT project, dst FROM net WHERE kind <> 'shared') x GROUP BY ALL""",
)
R.add(
    "occurrence_paths",
    "elements",
    lambda d: tv.occurrence_paths(d["elements"]),
    """, links AS (SELECT DISTINCT project, list_extract(string_split(path, '/'), -1) AS name, list_extract(string_split(path, '/'), -2) AS parent FROM elements WHERE contains(path, '/'))
    , up(project, name, top, full_path) AS (SELECT project, name, parent, concat(parent, '/', name) FROM links
        UNION SELECT u.project, u.name, l.parent, concat(l.parent, '/', u.full_path) FROM up u JOIN links l ON u.project = l.project AND u.top = l.name)
    SELECT DISTINCT project, name, full_path FROM up u WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.project = u.project AND l.name = u.top)""",
)
R.add(
    "link_checks",
    "links",
    lambda d: dc.link_checks(d["links"]),
    """SELECT project, path, url, starts_with(url, 'http://') OR starts_with(url, 'https://') OR (NOT starts_with(url, '/') AND NOT contains(url, '://')) AS valid,
       CASE WHEN starts_with(url, 'http') THEN 'external' ELSE 'local' END AS type FROM links""",
)

# ---- edits ----------------------------------------------------------------------------


def _tag_edits(d):
    action = F.when(F.col("persp") == "en", "add").when(F.col("persp") == "fr", "remove").when(F.col("persp") == "de", "set").otherwise("clear")
    return d["docs"].select("project", F.concat("persp", F.lit("/"), "topic", F.lit("/doc"), F.col("doc_id")).alias("path"), action.alias("action"), F.array(F.col("topic"), F.lit(" fresh ")).alias("tags"))


R.add(
    "update_tags",
    "meta docs",
    lambda d: dc.update_tags(d["meta"], _tag_edits(d)).select(*KEYS, F.array_join("tags", ",").alias("tags")),
    """SELECT project, path, CASE WHEN path NOT LIKE '%/doc%' THEN array_to_string(tags, ',')
        WHEN starts_with(path, 'en') THEN concat(array_to_string(tags, ','), ',fresh') WHEN starts_with(path, 'fr') THEN 'fr'
        WHEN starts_with(path, 'de') THEN concat(split_part(path, '/', 2), ',fresh') ELSE '' END AS tags FROM meta""",
)
R.add(
    "update_links",
    "links",
    lambda d: dc.update_links(
        d["links"].where("type = 'mirror'").distinct(),
        d["links"].where("type = 'external'").withColumn("action", F.lit("add")).unionByName(
            d["links"].where("type = 'mirror' AND url LIKE '%a%'").distinct().withColumn("action", F.lit("remove"))
        ),
    ),
    """, kept AS (SELECT DISTINCT project, path, url, type FROM links WHERE type = 'mirror' AND url NOT LIKE '%a%')
       SELECT * FROM kept UNION ALL SELECT DISTINCT project, path, url, type FROM links l WHERE type = 'external'
       AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.project = l.project AND k.path = l.path AND k.url = l.url)""",
)
R.add(
    "update_flows",
    "flows",
    lambda d: dc.update_flows(
        d["flows"],
        d["flows"].where("path = 'en'").withColumn("action", F.lit("set")).withColumn("description", F.lit("changed")).unionByName(
            d["flows"].where("path = 'fr'").withColumn("action", F.lit("remove"))
        ),
    ).select(*KEYS, "name", "description", F.array_join("steps", " ").alias("steps")),
    """SELECT project, path, name, CASE WHEN path = 'en' THEN 'changed' ELSE description END AS description, array_to_string(steps, ' ') AS steps
       FROM flows WHERE path <> 'fr'""",
)


def _mirror(d):
    return d["fields"].where("field IN ('description', 'note')"), d["fields"].where("field <> 'note'")


R.add(
    "merge_snapshots",
    "fields",
    lambda d: dc.merge_snapshots(*_mirror(d)),
    """SELECT project, path, field, text, CASE WHEN field IN ('description', 'note') THEN 'target' ELSE 'source' END AS origin FROM fields""",
)
R.add(
    "merge_counts",
    "fields",
    lambda d: dc.merge_counts(*_mirror(d)),
    """, p AS (SELECT project, path, count(*) FILTER (WHERE field = 'description') AS s, count(*) FILTER (WHERE field <> 'description') AS f
         FROM fields WHERE field <> 'note' GROUP BY ALL)
       SELECT project, count(*) FILTER (WHERE f > 0) AS copied, CAST(sum(s) AS BIGINT) AS skipped FROM p GROUP BY project""",
)
R.add(
    "snapshot_diff",
    "snapshot_old snapshot_new",
    lambda d: dc.snapshot_diff(d["snapshot_old"], d["snapshot_new"]),
    """SELECT project, path, CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'removed' ELSE 'modified' END AS change
       FROM snapshot_old o FULL JOIN snapshot_new n USING (project, path)
       WHERE o.content IS NULL OR n.content IS NULL OR o.content <> n.content""",
)

# ---- histories ------------------------------------------------------------------------

R.add(
    "diagram_history",
    "writes",
    lambda d: hs.diagram_history(d["writes"]),
    """, w AS (SELECT *, lag(text) OVER (PARTITION BY project, path ORDER BY written_at, seq) AS diagram,
         row_number() OVER (PARTITION BY project, path ORDER BY written_at DESC, seq DESC) AS age FROM writes WHERE field = 'diagram')
       SELECT project, path, CAST(age AS INTEGER) AS age, diagram, written_at AS replaced_at FROM w WHERE diagram IS NOT NULL AND age <= 20""",
)
R.add(
    "change_log",
    "writes",
    lambda d: hs.change_log(d["writes"]),
    """SELECT project, path, CAST(age AS INTEGER) AS age, field, written_at FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY written_at DESC, seq DESC) AS age FROM writes) w WHERE age <= 50""",
)
R.add(
    "write_stats",
    "writes",
    lambda d: hs.write_stats(d["writes"]),
    "SELECT project, path, min(written_at) AS created, max(written_at) AS updated, count(*) AS update_count, arg_max(field, seq) AS last_field FROM writes GROUP BY ALL",
)
R.add(
    "latest_by_key",
    "changes",
    lambda d: hs.latest_by_key(d["changes"], KEYS, ["seq"]),
    "SELECT project, ref, path, status, seq, ts FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY seq DESC) AS rn FROM changes) x WHERE rn = 1",
)
R.add(
    "upsert_file_index",
    "files changes",
    lambda d: hs.upsert_file_index(
        d["files"].select(*KEYS, F.lit("scan").alias("origin"), F.col("mtime").alias("last_analyzed")),
        d["changes"].groupBy(*KEYS).agg(F.lit("change").alias("origin"), F.max("ts").alias("last_analyzed")),
    ),
    """, b AS (SELECT project, path, 'scan' AS origin, mtime AS last_analyzed, 0 AS n FROM files
         UNION ALL SELECT project, path, 'change', max(ts), 1 FROM changes GROUP BY project, path)
       SELECT project, path, origin, last_analyzed FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY last_analyzed DESC, n DESC) AS rn FROM b) x WHERE rn = 1""",
)
R.add(
    "last_run_age",
    "changes",
    lambda d: hs.last_run_age(d["changes"].select("project", F.col("ts").alias("run_at")), "2024-02-01 00:00:00"),
    """, m AS (SELECT project, max(ts) AS last_run FROM changes GROUP BY project)
       SELECT project, last_run, CAST(floor(epoch(TIMESTAMP '2024-02-01 00:00:00' - last_run) / 60) AS BIGINT) AS age_minutes,
         floor(epoch(TIMESTAMP '2024-02-01 00:00:00' - last_run) / 60) > 60 AS overdue FROM m""",
)

# ---- scores -----------------------------------------------------------------------------


def _scores(d):
    return ql.score_elements(d["elements"], d["fields"], d["flows"], dg.extract_refs(d["fields"]), _lint(d))


SQL_SCORES = SQL_LINT + SQL_TYPES + """
, ff AS (SELECT project, path, count(*) FILTER (WHERE regexp_matches(text, '\\S')) AS fields_present,
      bool_or(field = 'diagram') AS has_diagram, max(CASE WHEN field = 'description' THEN length(text) END) AS dl,
      list_sort(list(field)) AS fl FROM fields GROUP BY ALL)
, fl AS (SELECT project, path, count(*) AS flow_count FROM flows GROUP BY ALL)
, ro AS (SELECT project, source_class AS path, count(*) AS refs_out FROM refs GROUP BY ALL)
, ri AS (SELECT project, target_class AS path, count(*) AS refs_in FROM refs WHERE NOT contains(source_class, '/') AND source_class <> target_class GROUP BY ALL)
, base AS (SELECT e.project, e.path, coalesce(fields_present, 0) AS fields_present, coalesce(has_diagram, false) AS has_diagram,
      coalesce(dl, 0) AS description_length, coalesce(flow_count, 0) AS flow_count, coalesce(refs_in, 0) AS refs_in, coalesce(refs_out, 0) AS refs_out,
      coalesce(children, 0) AS children, coalesce(covered, 0) AS covered, er.path IS NOT NULL AS invalid,
      array_to_string(list_filter(['description','diagram','constraint','concern','context','todo','note'], lambda x: NOT list_contains(coalesce(fl, []), x)), ',') AS fields_missing
    FROM elements e LEFT JOIN ff ON ff.project = e.project AND ff.path = e.path LEFT JOIN fl ON fl.project = e.project AND fl.path = e.path
    LEFT JOIN ro ON ro.project = e.project AND ro.path = e.path LEFT JOIN ri ON ri.project = e.project AND ri.path = e.path
    LEFT JOIN kids k ON k.project = e.project AND k.path = e.path LEFT JOIN errors er ON er.project = e.project AND er.path = e.path
    WHERE len(string_split(e.path, '/')) <= 2)
, pts AS (SELECT *, CASE WHEN NOT contains(path, '/') THEN 'perspective' WHEN has_diagram THEN 'group' ELSE 'leaf' END AS type,
      has_diagram AND NOT invalid AS diagram_valid, CAST(fields_present / 7 * 40 AS DOUBLE) AS fields_points,
      CAST(CASE WHEN has_diagram AND NOT invalid THEN 20 WHEN has_diagram THEN 10 ELSE 0 END AS DOUBLE) AS diagram_points,
      CAST(CASE WHEN description_length > 50 THEN 10 WHEN description_length > 20 THEN 5 ELSE 0 END AS DOUBLE) AS description_points,
      CAST(CASE WHEN flow_count > 0 THEN 10 ELSE 0 END AS DOUBLE) AS flows_points,
      CAST(CASE WHEN refs_in > 0 OR refs_out > 0 THEN 10 ELSE 0 END AS DOUBLE) AS refs_points,
      CAST(CASE WHEN children = covered THEN 10 ELSE covered / children * 10 END AS DOUBLE) AS children_points FROM base)
, scores AS (SELECT * EXCLUDE (invalid), CAST(floor(fields_points + diagram_points + description_points + flows_points + refs_points + children_points + 0.5) AS BIGINT) AS score FROM pts)
"""
R.add(
    "score_elements",
    "elements fields flows",
    lambda d: _scores(d).withColumn("description_length", F.col("description_length").cast("bigint")),
    SQL_SCORES + "SELECT * REPLACE (CAST(description_length AS BIGINT) AS description_length) FROM scores",
)


def _penalties(d):
    refs = dg.check_refs(dg.extract_refs(d["fields"]), d["elements"], "all").where("status = 'ref-exists'")
    stale = dc.check_signature(d["elements"], _stored(d))
    return ql.score_penalties(
        dg.undocumented_diagram_nodes(d["fields"], d["elements"]), refs, orphaned_sources(d["meta"], d["files"]), stale, d["elements"]
    )


SQL_PENALTIES = """
, und AS (SELECT project, count(*) AS u FROM dnodes n WHERE len(string_split(path, '/')) <= 2 AND NOT starts_with(node, '@') AND NOT starts_with(node, '__')
      AND NOT EXISTS (SELECT 1 FROM elements e WHERE e.project = n.project AND e.path = concat(n.path, '/', n.node)) GROUP BY project)
, brk AS (SELECT project, count(*) AS b FROM refs r WHERE source_class <> target_class
      AND NOT EXISTS (SELECT 1 FROM elements e WHERE e.project = r.project AND e.path = r.target_class) GROUP BY project)
, orp AS (SELECT project, count(*) AS o FROM (SELECT project, path, unnest(source_files) AS f FROM meta) m
      WHERE NOT EXISTS (SELECT 1 FROM files x WHERE x.project = m.project AND x.path = m.f) GROUP BY project)
, stl AS (SELECT project FROM elements GROUP BY project HAVING count(*) FILTER (WHERE starts_with(path, 'es')) > 0 AND count(*) FILTER (WHERE NOT starts_with(path, 'es')) > 0)
, pen AS (SELECT p.project, coalesce(u, 0) AS undocumented, coalesce(b, 0) AS broken, coalesce(o, 0) AS orphaned, stl.project IS NOT NULL AS stale,
      CAST(least(10, ceil(coalesce(u, 0) / 10)) + least(10, coalesce(b, 0) * 2) + least(5, ceil(coalesce(o, 0) / 5)) + CASE WHEN stl.project IS NOT NULL THEN 2 ELSE 0 END AS BIGINT) AS penalty
    FROM (SELECT DISTINCT project FROM elements) p LEFT JOIN und ON und.project = p.project LEFT JOIN brk ON brk.project = p.project
    LEFT JOIN orp ON orp.project = p.project LEFT JOIN stl ON stl.project = p.project)
"""
R.add(
    "score_penalties",
    "elements fields meta files",
    _penalties,
    sql_diagrams("fields") + SQL_REFS + SQL_PENALTIES + "SELECT * FROM pen",
)


def _summary(d):
    return ql.score_projects(_scores(d), _penalties(d))


SQL_SUMMARY = SQL_SCORES + SQL_PENALTIES + """
, summ AS (SELECT s.project, count(*) AS elements, count(*) FILTER (WHERE type = 'perspective') AS perspectives, count(*) FILTER (WHERE type = 'leaf') AS leaves,
      count(*) FILTER (WHERE type = 'group') AS groups, CAST(floor(sum(fields_present) / (count(*) * 7) * 100 + 0.5) AS BIGINT) AS field_coverage,
      CAST(floor(count(*) FILTER (WHERE has_diagram) / count(*) * 100 + 0.5) AS BIGINT) AS diagram_coverage,
      CAST(floor(count(*) FILTER (WHERE flow_count > 0) / count(*) * 100 + 0.5) AS BIGINT) AS flow_coverage,
      CAST(floor(count(*) FILTER (WHERE refs_in > 0 OR refs_out > 0) / count(*) * 100 + 0.5) AS BIGINT) AS ref_integrity,
      CAST(floor(sum(score) / count(*) + 0.5) AS BIGINT) AS raw_score, any_value(p.penalty) AS penalty FROM scores s JOIN pen p ON p.project = s.project GROUP BY s.project)
, overall AS (SELECT *, greatest(0, raw_score - penalty) AS overall_score FROM summ)
"""
R.add("score_projects", "elements fields flows meta files", _summary, SQL_SUMMARY + "SELECT * FROM overall")
R.add(
    "quality_gate",
    "elements fields flows meta files",
    lambda d: ql.quality_gate(_summary(d), 40, ql.GATE_MINIMA),
    SQL_SUMMARY + """SELECT project, overall_score, overall_score >= 40 AND field_coverage >= 50 AND diagram_coverage >= 50 AND flow_coverage >= 30
      AND ref_integrity >= 20 AS passed FROM overall""",
)


def _raw_tags(d):
    """Tags as JSON; a perspective's list holds one entry that is no text, one in 'es...' two."""
    name = F.concat(F.lit('["'), F.col("path"), F.lit('"'))
    odd = F.when(F.col("path").startswith("es"), ', 1, {"a": 2}').when(~F.col("path").contains("/"), ", 3").otherwise("")
    return d["elements"].select(*KEYS, F.concat(name, odd, F.lit("]")).alias("tags_json"))


def _issues(d):
    return ql.quality_issues(
        _scores(d),
        dg.undocumented_diagram_nodes(d["fields"], d["elements"]),
        corrupted_tags=dc.split_tags(_raw_tags(d)),
        stale=dc.check_signature(d["elements"], _stored(d)),
        orphans=orphaned_sources(d["meta"], d["files"]),
        broken_refs=dg.check_refs(dg.extract_refs(d["fields"]), d["elements"], "all").where("status = 'ref-exists'"),
    )


SQL_ISSUES = SQL_SCORES + SQL_PENALTIES + """
, issues AS (
    SELECT project, path, 'missing-description' AS type, 'warning' AS severity, CAST(1 AS BIGINT) AS amount FROM scores WHERE description_length = 0
    UNION ALL SELECT project, path, 'invalid-diagram', 'error', 1 FROM scores WHERE has_diagram AND NOT diagram_valid
    UNION ALL SELECT project, path, 'incomplete-children', 'warning', children - covered FROM scores WHERE type <> 'leaf' AND covered < children
    UNION ALL SELECT project, path, 'sparse-fields', 'info', fields_present FROM scores WHERE fields_present < 4
    UNION ALL SELECT project, path, 'no-flows', 'info', 1 FROM scores WHERE type = 'perspective' AND flow_count = 0
    UNION ALL SELECT project, concat(path, '/', node), 'undocumented-diagram-node', 'warning', 1 FROM dnodes n
      WHERE len(string_split(path, '/')) <= 2 AND NOT starts_with(node, '@') AND NOT starts_with(node, '__')
      AND NOT EXISTS (SELECT 1 FROM elements e WHERE e.project = n.project AND e.path = concat(n.path, '/', n.node))
    UNION ALL SELECT project, path, 'corrupted-tags', 'warning', CASE WHEN starts_with(path, 'es') THEN 2 ELSE 1 END FROM elements
      WHERE starts_with(path, 'es') OR NOT contains(path, '/')
    UNION ALL SELECT project, NULL, 'stale-signature', 'info', 1 FROM stl
    UNION ALL SELECT project, NULL, 'orphaned-sources', 'warning', o FROM orp
    UNION ALL SELECT project, NULL, 'broken-refs', 'warning', b FROM brk)
"""
R.add("quality_issues", "elements fields flows meta files", _issues, SQL_ISSUES + "SELECT * FROM issues")
R.add(
    "issue_counts",
    "elements fields flows meta files",
    lambda d: ql.issue_counts(_issues(d)),
    SQL_ISSUES + "SELECT project, severity, count(*) AS issues FROM issues GROUP BY ALL",
)
R.add(
    "quick_score",
    "elements fields flows",
    lambda d: ql.quick_score(d["elements"], d["fields"], _lint(d)),
    SQL_SCORES + """
    , lerr AS (SELECT DISTINCT project, path FROM lint WHERE rule IN ('graph-declaration', 'balanced-brackets', 'reserved-word'))
    , q AS (SELECT b.project, b.path, fields_present AS n, has_diagram AS g, has_diagram AND l.path IS NULL AS ok,
        fields_present / 7 * 40 + CASE WHEN has_diagram AND l.path IS NULL THEN 20 WHEN has_diagram THEN 10 ELSE 0 END
        + CASE WHEN description_length > 50 THEN 10 ELSE 0 END AS s
      FROM base b LEFT JOIN lerr l ON l.project = b.project AND l.path = b.path WHERE NOT contains(b.path, '/'))
    SELECT project, CAST(floor(round(sum(s) / count(*), 9) + 0.5) AS BIGINT) AS score, count(*) AS elements,
      CAST(floor(sum(n) / (count(*) * 7) * 100 + 0.5) AS BIGINT) AS field_coverage, CAST(floor(count(*) FILTER (WHERE g) / count(*) * 100 + 0.5) AS BIGINT) AS diagram_coverage,
      count(*) FILTER (WHERE ok) AS valid_diagrams FROM q GROUP BY project""",
)
R.add(
    "improvement_ranking",
    "elements fields flows",
    lambda d: ql.improvement_ranking(_scores(d)),
    SQL_SCORES + """, g AS (SELECT project, path, type, 40.0 - fields_points AS gain_fields, 20.0 - diagram_points AS gain_diagram, 10.0 - description_points AS gain_description,
        10.0 - flows_points AS gain_flows, 10.0 - refs_points AS gain_refs, 10.0 - children_points AS gain_children,
        round(100.0 - fields_points - diagram_points - description_points - flows_points - refs_points - children_points, 9) AS gap FROM scores)
      SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY gap DESC, path) AS rn FROM g WHERE gap > 0) x WHERE rn <= 10""",
)
R.add(
    "worst_elements",
    "elements fields flows",
    lambda d: ql.worst_elements(_scores(d)),
    SQL_SCORES + """SELECT project, path, type, score, fields_missing FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score, path) AS rn FROM scores WHERE score < 80) x WHERE rn <= 10""",
)
R.add(
    "feedback_report",
    "elements fields flows meta files",
    lambda d: sinks.to_report_json(ql.feedback_report(_summary(d), _scores(d), _issues(d))),
)

# ---- texts -------------------------------------------------------------------------------

R.add(
    "dependency_diagram",
    "edges",
    lambda d: sinks.dependency_diagram(d["edges"]),
    """, ids AS (SELECT project, file, row_number() OVER (PARTITION BY project ORDER BY file) - 1 AS n FROM (
         SELECT project, src AS file FROM edges UNION SELECT project, dst FROM edges) f)
       SELECT DISTINCT project, 0 AS part, CAST(0 AS BIGINT) AS number, CAST(0 AS BIGINT) AS target, 'graph LR' AS line FROM edges
       UNION ALL SELECT project, 1, n, 0, concat('    n', n, '["', regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^.]+$', ''), '\\n', file, '"]') FROM ids
       UNION ALL SELECT e.project, 2, s.n, t.n, concat('    n', s.n, ' -->|"', CASE WHEN len(imports) > 0 THEN array_to_string(imports[1:3], ', ') ELSE 'imports' END, '"| n', t.n)
         FROM edges e JOIN ids s ON s.project = e.project AND s.file = e.src JOIN ids t ON t.project = e.project AND t.file = e.dst""",
)
R.add(
    "wiki_lines",
    "elements fields",
    lambda d: sinks.wiki_lines(d["elements"], d["fields"]),
    """, k AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent FROM elements WHERE contains(path, '/'))
    SELECT DISTINCT project, 'index' AS page, 0 AS part, '' AS item, concat('# Architecture Wiki', chr(10), chr(10), '## Perspectives', chr(10)) AS line FROM elements
    UNION ALL SELECT project, 'index', 1, path, concat('- [[', path, ']]') FROM elements WHERE NOT contains(path, '/')
    UNION ALL SELECT DISTINCT project, 'index', 2, '', concat(chr(10), '## All Elements', chr(10)) FROM elements
    UNION ALL SELECT project, 'index', 3, path, concat('- [[', path, ']]') FROM elements
    UNION ALL SELECT project, path, 0, '', concat('# ', path, chr(10)) FROM elements
    UNION ALL SELECT project, path, 1, '', concat(text, chr(10)) FROM fields WHERE field = 'description' AND regexp_matches(text, '\\S')
    UNION ALL SELECT project, path, 2, '', concat('## Diagram', chr(10), chr(10), '```', chr(10), text, chr(10), '```', chr(10)) FROM fields WHERE field = 'diagram'
    UNION ALL SELECT project, path, 3, '', concat('## Context', chr(10), chr(10), text, chr(10)) FROM fields WHERE field = 'context'
    UNION ALL SELECT DISTINCT project, parent, 4, '', concat('## Children', chr(10)) FROM k
    UNION ALL SELECT project, parent, 5, path, concat('- [[', path, ']]') FROM k
    UNION ALL SELECT project, path, 6, '', concat(chr(10), '## Parent', chr(10), chr(10), '[[', parent, ']]') FROM k""",
)
R.add(
    "report_json",
    "elements fields",
    lambda d: sinks.to_report_json(dc.children_coverage(d["elements"], d["fields"])),
    SQL_TYPES + """SELECT project, concat('{"project":"', project, '","path":"', path, '","children":', children, ',"covered":', covered, '}') AS json FROM kids""",
)

