"""Code and documentation tables derived from the given parquet tables.

The given tables hold no source code, so tests, queries and the benchmark derive
it: suppliers are projects, orders and parts are files, line items are imports,
documents are documentation elements, events are file changes.  Each derived
table is one SQL text; the few spellings that differ between engines come from
`Dialect`, so the same text also serves as the view an independent SQL engine
checks our results against.  Every derivation reads the whole of its tables.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.session import shared_root, sorted_aggregates

# Files per project: line items per project stay constant as the tables grow,
# so this keeps the import graph sparse (about 0.6 imports per file).
FILES_PER_PROJECT = 1009


@dataclass(frozen=True)
class Dialect:
    """The spellings that differ between Spark SQL and DuckDB."""

    spark: bool

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def empty(self) -> str:
        return "CAST(array() AS array<string>)" if self.spark else "CAST([] AS VARCHAR[])"

    def replace_all(self, text: str, pattern: str, repl: str) -> str:
        if self.spark:
            repl = repl.replace("\\1", "$1").replace("\\2", "$2")
            return f"regexp_replace({text}, r'{pattern}', '{repl}')"
        return f"regexp_replace({text}, '{pattern}', '{repl}', 'g')"

    def extract_all(self, text: str, pattern: str, group: int) -> str:
        p = f"r'{pattern}'" if self.spark else f"'{pattern}'"
        return f"regexp_extract_all({text}, {p}, {group})"

    def join_rows(self, expr: str, sep: str, order: str) -> str:
        """Concatenate rows of a group in order."""
        if self.spark:
            return f"listagg({expr}, {sep}) WITHIN GROUP (ORDER BY {order})"
        return f"string_agg({expr}, {sep} ORDER BY {order})"

    def sorted_list(self, expr: str) -> str:
        """Sorted array of the non-null values of a group."""
        if self.spark:
            return f"sort_array(collect_list({expr}))"
        return f"coalesce(list({expr} ORDER BY {expr}) FILTER (WHERE {expr} IS NOT NULL), CAST([] AS VARCHAR[]))"

    def ts(self, text: str) -> str:
        return f"TIMESTAMP '{text}'"

    def days(self, expr: str) -> str:
        return f"make_interval(0, 0, 0, {expr}, 0, 0, 0)" if self.spark else f"to_days(CAST({expr} AS INTEGER))"


def _layer(n: str) -> str:
    return (
        f"CASE {n} % 7 WHEN 0 THEN 'ui' WHEN 1 THEN 'api' WHEN 2 THEN 'service' WHEN 3 THEN 'data' "
        f"WHEN 4 THEN 'utils' WHEN 5 THEN 'build' ELSE 'core' END"
    )


def _ext(n: str) -> str:
    return f"CASE {n} % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '.test.ts' END"


def _stem(n: str) -> str:
    # every third stem ends in `.test`, whose extension is then `.ts`
    return f"concat('m', {n}, CASE {n} % 3 WHEN 2 THEN '.test' ELSE '' END)"


def _path(n: str) -> str:
    return f"concat('src/', {_layer(n)}, '/m', {n}, {_ext(n)})"


def definitions(d: Dialect) -> dict[str, str]:
    """Name -> SQL of every derived table, in dependency order."""
    k = FILES_PER_PROJECT
    t: dict[str, str] = {}

    # ---- code -----------------------------------------------------------
    t["uses"] = f"""
        SELECT concat('s', l_suppkey) AS project,
               l_orderkey % {k} AS src_id, l_partkey % {k} AS dst_id,
               CASE WHEN l_returnflag = 'R' THEN NULL
                    ELSE concat(replace(p_name, ' ', '_'), '_', p_partkey) END AS symbol,
               l_partkey AS partkey, l_linenumber AS linenumber, l_quantity AS quantity,
               l_shipdate AS shipdate
        FROM lineitem JOIN part ON l_partkey = p_partkey"""
    t["edges"] = f"""
        SELECT project, {_path('src_id')} AS src, {_path('dst_id')} AS dst, {d.sorted_list('symbol')} AS imports
        FROM uses WHERE src_id <> dst_id GROUP BY project, src_id, dst_id"""
    # one project that grows with the data: a binary tree whose files import their parents and children,
    # so one component with paths of logarithmic length, a hub that every seventh file imports, and leaves outside the component
    t["grown_edges"] = f"""
        SELECT DISTINCT 'grown' AS project, {_path('a')} AS src, {_path('b')} AS dst, {d.empty()} AS imports FROM (
          SELECT o_orderkey AS a, CAST(floor(o_orderkey / 2) AS BIGINT) AS b FROM orders WHERE o_orderkey > 1
          UNION ALL SELECT CAST(floor(o_orderkey / 2) AS BIGINT) AS a, o_orderkey AS b FROM orders WHERE o_orderkey > 1
          UNION ALL SELECT o_orderkey AS a, CAST(1 AS BIGINT) AS b FROM orders WHERE o_orderkey % 7 = 0
          UNION ALL SELECT o_orderkey AS a, o_orderkey + 1000000000000 AS b FROM orders WHERE o_orderkey % 3 = 0) ends"""
    t["grown_files"] = """
        SELECT project, src AS file FROM grown_edges UNION SELECT project, dst AS file FROM grown_edges"""
    t["node_files"] = f"""
        SELECT project, {_path('id')} AS file, count(*) AS uses_n, max(shipdate) AS touched
        FROM (SELECT project, src_id AS id, shipdate FROM uses
              UNION ALL SELECT project, dst_id AS id, shipdate FROM uses) both_ends
        GROUP BY project, id"""
    t["exports"] = f"""
        SELECT DISTINCT concat('s', l_suppkey) AS project, {_path(f'(l_partkey % {k})')} AS file,
               CASE WHEN p_type = 'PROMO' THEN 'default'
                    ELSE concat(replace(p_name, ' ', '_'), '_', p_partkey) END AS name,
               CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'STANDARD' THEN 'class'
                           WHEN 'PROMO' THEN 'function' WHEN 'SMALL' THEN 'variable'
                           WHEN 'MEDIUM' THEN 'interface' ELSE 'type' END AS kind,
               CAST(p_partkey AS INT) AS line
        FROM lineitem JOIN part ON l_partkey = p_partkey"""
    t["code_definitions"] = f"""
        SELECT DISTINCT concat('s', l_suppkey) AS project, {_path(f'(l_partkey % {k})')} AS file,
               concat(replace(p_name, ' ', '_'), '_', p_partkey % 3) AS name,
               CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'STANDARD' THEN 'class'
                           WHEN 'PROMO' THEN 'function' WHEN 'SMALL' THEN 'variable'
                           WHEN 'MEDIUM' THEN 'interface' ELSE 'type' END AS kind,
               CAST(p_partkey AS INT) AS line, CAST(p_partkey + p_size * 2 AS INT) AS end_line,
               p_type <> 'SMALL' AS exported, p_brand AS brand
        FROM lineitem JOIN part ON l_partkey = p_partkey"""
    # earlier state: one brand did not exist yet, two were shorter, one has since gone
    t["old_definitions"] = """
        SELECT project, file, name, kind, line,
               CASE WHEN brand IN ('Brand#3', 'Brand#4') THEN end_line - 1 ELSE end_line END AS end_line, exported
        FROM code_definitions WHERE brand <> 'Brand#1'"""
    t["new_definitions"] = """
        SELECT project, file, name, kind, line, end_line, exported
        FROM code_definitions WHERE brand <> 'Brand#2'"""
    t["source_lines"] = f"""
        SELECT project, {_path('src_id')} AS file, 0 AS block, partkey, linenumber,
               CASE WHEN symbol IS NULL
                    THEN concat('import def', partkey, ' from ''../', {_layer('dst_id')}, '/', {_stem('dst_id')}, ''';')
                    ELSE concat('import {{ ', symbol, ' }} from ''../', {_layer('dst_id')}, '/', {_stem('dst_id')}, ''';')
               END AS line_text
        FROM uses
        UNION ALL
        SELECT DISTINCT project, {_path('src_id')} AS file, -1 AS block, src_id AS partkey, 0 AS linenumber,
               CASE src_id % 4 WHEN 0 THEN concat('/* import no', src_id, ' from ''./no'';', chr(10), 'export function no() {{}} */')
                               WHEN 1 THEN concat('const text', src_id, ' = `', chr(10), 'import no from ''./no'';', chr(10), '`;')
                               WHEN 2 THEN concat('// import no', src_id, ' from ''./no''; export class No {{}}')
                               ELSE concat('const t', src_id, ' = "require(''./no'')"; /* export class No {{}} */') END AS line_text
        FROM uses
        UNION ALL
        SELECT project, file, 1 AS block, CAST(line AS BIGINT) AS partkey, 0 AS linenumber,
               CASE kind WHEN 'function' THEN concat('export function ', name, '() {{ return ', line, '; }}')
                         WHEN 'class' THEN concat('export class ', name, ' {{}}')
                         WHEN 'interface' THEN concat('export interface ', name, ' {{}}')
                         WHEN 'type' THEN concat('export type ', name, ' = string;')
                         ELSE concat('export const ', name, ' = ', line, ';') END AS line_text
        FROM exports""".replace("{{", "{").replace("}}", "}")
    t["source_files"] = f"""
        SELECT project, file AS path, {d.join_rows('line_text', 'chr(10)', 'block, partkey, linenumber, line_text')} AS content
        FROM source_lines GROUP BY project, file"""
    t["files"] = """
        SELECT project, file AS path, uses_n * 100 AS size, touched AS mtime FROM node_files"""

    # ---- documentation ---------------------------------------------------
    t["docs"] = f"""
        SELECT concat('s', substring(d.source, 4)) AS project, d.lang AS persp,
               CASE WHEN l.quality IS NULL THEN 'raw' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS topic,
               l.toxic AS toxic, d.doc_id AS doc_id, d.text AS text, d.n_chars AS n_chars
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
    t["elements"] = """
        SELECT DISTINCT project, persp AS path FROM docs
        UNION ALL SELECT DISTINCT project, concat(persp, '/', topic) AS path FROM docs
        UNION ALL SELECT project, concat(persp, '/', topic, '/doc', doc_id) AS path FROM docs"""
    persp_diagram = (
        "concat('graph LR', chr(10), '  ', persp, '[\"Docs in ', persp, '\"] -->|next| @',"
        " CASE persp WHEN 'en' THEN 'fr' WHEN 'fr' THEN 'de' WHEN 'de' THEN 'es' ELSE 'en' END, chr(10),"
        " '  raw --> good', chr(10), '  good --> poor', chr(10),"
        " CASE persp WHEN 'es' THEN '  gone[\"see @missing\"]' WHEN 'fr' THEN '  self[\"see @fr\"]'"
        " ELSE '  extra(Extra)' END)"
    )
    topic_diagram = (
        "CASE topic WHEN 'good' THEN concat('flowchart TD', chr(10), '  a[\"Input\"] -->|reads| b[\"Output\"]', chr(10),"
        " '  end[Stop] --> c{x}', chr(10), '  classDef external fill:#000000,stroke:#585b70', chr(10),"
        " '  classDef custom fill:#fff')"
        " ELSE concat('a --> b', chr(10), 'c[open --> d', chr(10), '%% note', chr(10), 'e[\"A <b> c\"] --> f') END"
    )
    word_diagram = (
        "concat('graph LR', chr(10), "
        + d.replace_all("lower(text)", "([a-z]+)[ .,]+([a-z]+)[ .,]*", "\\1 --> \\2\n").replace("\n", "'||chr(10)||'")
        + ")"
    )
    t["fields"] = f"""
        SELECT project, path, field, text FROM (
          SELECT DISTINCT project, persp AS path, 'description' AS field,
                 concat('All documents written in ', persp) AS text FROM docs
          UNION ALL SELECT DISTINCT project, persp AS path, 'diagram' AS field, {persp_diagram} AS text FROM docs
          UNION ALL SELECT DISTINCT project, concat(persp, '/', topic) AS path, 'diagram' AS field,
                 {topic_diagram} AS text FROM docs WHERE topic <> 'raw'
          UNION ALL SELECT DISTINCT project, concat(persp, '/', topic) AS path, 'note' AS field,
                 concat('topic ', topic) AS text FROM docs
          UNION ALL SELECT project, concat(persp, '/', topic, '/doc', doc_id) AS path, 'description' AS field, text FROM docs
          UNION ALL SELECT project, concat(persp, '/', topic, '/doc', doc_id) AS path, 'context' AS field,
                 concat('Size ', n_chars, ' characters') AS text FROM docs
          UNION ALL SELECT project, concat(persp, '/', topic, '/doc', doc_id) AS path, 'constraint' AS field,
                 'must not be toxic' AS text FROM docs WHERE toxic = 0
          UNION ALL SELECT project, concat(persp, '/', topic, '/doc', doc_id) AS path, 'concern' AS field,
                 'is toxic' AS text FROM docs WHERE toxic = 1
          UNION ALL SELECT project, concat(persp, '/', topic, '/doc', doc_id) AS path, 'diagram' AS field,
                 {word_diagram} AS text FROM docs WHERE toxic IS NOT NULL
        ) all_fields"""
    t["flows"] = f"""
        SELECT DISTINCT project, persp AS path, concat('tour of ', persp) AS name, 'reading order' AS description,
               {d.arr("'raw'", "'raw->good'", "'good->poor'", "'poor'")} AS steps
        FROM docs WHERE persp <> 'de'"""
    t["meta"] = f"""
        SELECT project, persp AS path, CAST(NULL AS STRING) AS git_commit, {d.ts('2024-01-01 00:00:00')} AS updated,
               CAST({d.empty()} AS {'array<string>' if d.spark else 'VARCHAR[]'}) AS source_files,
               CASE WHEN persp = 'en' THEN {d.arr("'src/{api,data}/*.ts'", "'**/*.md'")} ELSE {d.empty()} END AS source_globs,
               {d.arr("'Lang'", 'persp')} AS tags
        FROM (SELECT DISTINCT project, persp FROM docs) p
        UNION ALL
        SELECT project, concat(persp, '/', topic) AS path, 'c1' AS git_commit, {d.ts('2024-01-01 00:00:00')} AS updated,
               {d.empty()} AS source_files,
               CASE topic WHEN 'good' THEN {d.arr("'src/ui/**'", "'src/ui/m[1-4]*.js'")}
                          WHEN 'poor' THEN {d.arr("'src/**/m?.ts'")} ELSE {d.empty()} END AS source_globs,
               {d.arr("'Topic'", 'topic')} AS tags
        FROM (SELECT DISTINCT project, persp, topic FROM docs) g
        UNION ALL
        SELECT project, concat(persp, '/', topic, '/doc', doc_id) AS path,
               CASE persp WHEN 'en' THEN 'c1' WHEN 'fr' THEN 'c2' ELSE NULL END AS git_commit,
               {d.ts('1998-01-01 00:00:00')} + {d.days('doc_id % 2000')} AS updated,
               CASE WHEN toxic IS NULL THEN {d.empty()}
                    ELSE {d.arr(_path(f'(doc_id % {k})'), _path(f'((doc_id * 7) % {k})'))} END AS source_files,
               CASE WHEN toxic = 1 THEN {d.arr("concat('src/core/m', doc_id % 10, '*.js')")} ELSE {d.empty()} END AS source_globs,
               {d.arr('persp', 'topic')} AS tags
        FROM docs"""
    t["changes"] = f"""
        SELECT concat('s', user_id % 20) AS project,
               CASE WHEN event_type IN ('view', 'error') THEN NULL
                    WHEN ts < {d.ts('2024-01-16 00:00:00')} THEN 'c1' ELSE 'c2' END AS ref,
               {_path(f'(CAST(floor(value * 10) AS BIGINT) % {k})')} AS path,
               CASE event_type WHEN 'click' THEN 'modified' WHEN 'signup' THEN 'added' WHEN 'purchase' THEN 'renamed'
                               WHEN 'view' THEN 'untracked' ELSE 'deleted' END AS status,
               event_id AS seq, ts
        FROM events"""
    # two snapshots of the documentation: one language arrived, one left, one was rewritten
    t["snapshot_old"] = """
        SELECT project, concat(persp, '/doc', doc_id) AS path, text AS content FROM docs WHERE persp <> 'es'"""
    t["snapshot_new"] = """
        SELECT project, concat(persp, '/doc', doc_id) AS path,
               CASE WHEN persp = 'de' THEN concat('Neu: ', text) ELSE text END AS content FROM docs WHERE persp <> 'fr'"""
    # every turn of a conversation rewrites that conversation's diagram or note
    t["writes"] = f"""
        SELECT concat('s', conv_id % 20) AS project, concat('conv', conv_id) AS path,
               CASE role WHEN 'user' THEN 'note' ELSE 'diagram' END AS field, text,
               turn AS seq, {d.ts('2024-01-01 00:00:00')} + {d.days('turn')} AS written_at
        FROM conversations"""
    t["links"] = f"""
        SELECT concat('s', page_id % 20) AS project, concat('page', page_id) AS path, url, 'external' AS type
        FROM pages
        UNION ALL
        SELECT concat('s', page_id % 20) AS project, concat('page', page_id) AS path, url, 'mirror' AS type
        FROM (SELECT page_id, {'explode' if d.spark else 'unnest'}({d.extract_all('html', 'href="([^"]*)"', 1)}) AS url FROM pages) hrefs"""
    return t


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_DEPENDS = {
    "uses": ["lineitem", "part"],
    "edges": ["uses"],
    "node_files": ["uses"],
    "grown_edges": ["orders"],
    "grown_files": ["grown_edges"],
    "exports": ["lineitem", "part"],
    "code_definitions": ["lineitem", "part"],
    "old_definitions": ["code_definitions"],
    "new_definitions": ["code_definitions"],
    "source_lines": ["uses", "exports"],
    "source_files": ["source_lines"],
    "files": ["node_files"],
    "docs": ["documents", "labels"],
    "elements": ["docs"],
    "fields": ["docs"],
    "flows": ["docs"],
    "meta": ["docs"],
    "changes": ["events"],
    "snapshot_old": ["docs"],
    "snapshot_new": ["docs"],
    "writes": ["conversations"],
    "links": ["pages"],
}


def _needed(names: list[str]) -> list[str]:
    want: set[str] = set()

    def visit(n: str) -> None:
        if n in _DEPENDS and n not in want:
            want.add(n)
            for m in _DEPENDS[n]:
                visit(m)

    for n in names:
        visit(n)
    return [n for n in _DEPENDS if n in want]


def oracle_ctes(*names: str) -> str:
    """`WITH ...` prefix that defines the named derived tables for DuckDB."""
    sql = definitions(Dialect(spark=False))
    parts = [f"{n} AS ({sql[n]})" for n in _needed(list(names))]
    return "WITH RECURSIVE " + ",\n".join(parts)


# ---- how Spark derives tables of many small groups ----------------------------
#
# The SQL above says what these tables hold, and SQL engines are checked against it.  Run as it stands, it makes partial
# lists that are sorted on both sides of a shuffle, and tells texts apart that a few numbers tell apart.  These forms
# send the numbers of a line item to its part once, then to its group, and make texts last.

Tables = Callable[[str], DataFrame]

_SYMBOL = "concat(replace(p_name, ' ', '_'), '_', p_partkey)"
_KIND = (
    "CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'STANDARD' THEN 'class' WHEN 'PROMO' THEN 'function'"
    " WHEN 'SMALL' THEN 'variable' WHEN 'MEDIUM' THEN 'interface' ELSE 'type' END"
)


def _gathered(rows: DataFrame, keys: list[str], lists: Column) -> DataFrame:
    """A row per group, from rows that are partitioned by the keys: sorted once and gathered as they come, without partial lists."""
    return rows.sortWithinPartitions(*keys).groupBy(*keys).agg(lists)


def _sold(table: Tables, *columns: str) -> DataFrame:
    """Each pair of supplier and part of a line item once, with expressions over the part: (supp, p_partkey, *columns)."""
    pairs = table("lineitem").select(F.col("l_suppkey").alias("supp"), "l_partkey").where("l_partkey IS NOT NULL").repartition("l_partkey").distinct()
    parts = table("part").selectExpr("p_partkey", *columns).distinct()
    return pairs.join(parts, pairs["l_partkey"] == parts["p_partkey"]).drop("l_partkey")


def _exports(table: Tables) -> DataFrame:
    name = f"CASE WHEN p_type = 'PROMO' THEN 'default' ELSE {_SYMBOL} END AS name"
    return _sold(table, name, f"{_KIND} AS kind").selectExpr(
        "concat('s', supp) AS project", f"{_path(f'(p_partkey % {FILES_PER_PROJECT})')} AS file", "name", "kind", "CAST(p_partkey AS INT) AS line"
    )


def _code_definitions(table: Tables) -> DataFrame:
    name = "concat(replace(p_name, ' ', '_'), '_', p_partkey % 3) AS name"
    end_line = "CAST(p_partkey + p_size * 2 AS INT) AS end_line"
    return _sold(table, name, f"{_KIND} AS kind", end_line, "p_type <> 'SMALL' AS exported", "p_brand AS brand").selectExpr(
        "concat('s', supp) AS project", f"{_path(f'(p_partkey % {FILES_PER_PROJECT})')} AS file", "name", "kind",
        "CAST(p_partkey AS INT) AS line", "end_line", "exported", "brand",
    )


def _imported(table: Tables, *columns: str) -> DataFrame:
    """Line items with their parts: (supp, src_id, partkey, linenumber, unnamed) and expressions over the part."""
    items = table("lineitem").selectExpr(
        "l_suppkey AS supp", f"l_orderkey % {FILES_PER_PROJECT} AS src_id", "l_partkey AS partkey", "l_linenumber AS linenumber",
        "l_returnflag <=> 'R' AS unnamed",
    )
    return items.join(table("part").selectExpr("p_partkey AS partkey", *columns), "partkey")


def _edges(table: Tables) -> DataFrame:
    rows = _imported(table, f"{_SYMBOL} AS symbol").selectExpr(
        "supp", "src_id", f"partkey % {FILES_PER_PROJECT} AS dst_id", "CASE WHEN NOT unnamed THEN symbol END AS symbol"
    )
    keys = ["supp", "src_id", "dst_id"]
    groups = _gathered(rows.where("src_id <> dst_id").repartition(*keys), keys, F.collect_list("symbol").alias("symbols"))
    return groups.selectExpr("concat('s', supp) AS project", f"{_path('src_id')} AS src", f"{_path('dst_id')} AS dst", "sort_array(symbols) AS imports")


def _source_files(table: Tables) -> DataFrame:
    items = _imported(table, "p_name AS name", f"CASE WHEN p_type = 'PROMO' THEN 'default' ELSE {_KIND} END AS kind")
    # of a line item come an import in the file of its order and, once, an export in the file of its part; the symbol is made from its name at the end
    rows = items.selectExpr(
        "supp",
        f"""inline(array(
            named_struct('id', src_id, 'block', 0, 'partkey', partkey, 'linenumber', linenumber,
                         'name', CASE WHEN NOT unnamed THEN name END, 'kind', CAST(NULL AS STRING)),
            named_struct('id', partkey % {FILES_PER_PROJECT}, 'block', 1, 'partkey', partkey, 'linenumber', 0,
                         'name', CASE WHEN kind <> 'default' THEN name END, 'kind', kind)))""",
    )
    source = f"concat(' from ''../', {_layer('dst_id')}, '/', {_stem('dst_id')}, ''';')"
    symbol = "CASE WHEN kind = 'default' THEN kind ELSE concat(replace(name, ' ', '_'), '_', partkey) END AS symbol"
    texts = rows.repartition("supp", "id").selectExpr("*", f"partkey % {FILES_PER_PROJECT} AS dst_id", symbol).selectExpr(
        "supp", "id", "block", "partkey", "linenumber",
        f"""CASE WHEN block = 0 AND symbol IS NULL THEN concat('import def', partkey, {source})
                 WHEN block = 0 THEN concat('import {{ ', symbol, ' }}', {source})
                 WHEN kind IN ('function', 'default') THEN concat('export function ', symbol, '() {{ return ', CAST(partkey AS INT), '; }}')
                 WHEN kind = 'class' THEN concat('export class ', symbol, ' {{}}')
                 WHEN kind = 'interface' THEN concat('export interface ', symbol, ' {{}}')
                 WHEN kind = 'type' THEN concat('export type ', symbol, ' = string;')
                 ELSE concat('export const ', symbol, ' = ', CAST(partkey AS INT), ';') END AS line_text""",
    )
    lines = F.collect_list(F.struct("block", "partkey", "linenumber", "line_text")).alias("lines")
    first = """CASE id % 4 WHEN 0 THEN concat('/* import no', id, ' from ''./no'';', chr(10), 'export function no() {} */')
                           WHEN 1 THEN concat('const text', id, ' = `', chr(10), 'import no from ''./no'';', chr(10), '`;')
                           WHEN 2 THEN concat('// import no', id, ' from ''./no''; export class No {}')
                           ELSE concat('const t', id, ' = "require(''./no'')"; /* export class No {} */') END"""
    return (
        _gathered(texts, ["supp", "id"], lines)
        .selectExpr("supp", "id", "filter(lines, x -> x.block = 0) AS imports", "array_distinct(filter(lines, x -> x.block = 1)) AS exports")
        .selectExpr(
            "concat('s', supp) AS project",
            f"{_path('id')} AS path",
            f"""nullif(array_join(concat(
                    CASE WHEN size(imports) > 0 THEN array({first}) ELSE array() END,
                    transform(sort_array(imports), x -> x.line_text), transform(sort_array(exports), x -> x.line_text)), chr(10)), '') AS content""",
        )
    )


_BUILT: dict[str, Callable[[Tables], DataFrame]] = {
    "edges": _edges,
    "exports": _exports,
    "code_definitions": _code_definitions,
    "source_files": _source_files,
}

_STORED: dict[tuple[str, str, str], str] = {}


class Derived:
    """Derived tables of one data folder: `Derived(spark, sf_dir)["edges"]`.

    A derived table is computed once per session, stored as Parquet in the
    shared folder and read from there, as a deployment would keep these tables:
    queries then start from real tables, with column pruning, pushed filters
    and file sizes to plan from.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._sql = definitions(Dialect(spark=True))

    def lazy(self, name: str) -> DataFrame:
        """The derivation itself, unstored."""
        if name in _BUILT:
            return _BUILT[name](self.__getitem__)
        needed = [n for n in _needed([name]) if n != name]
        built = [n for n in needed if n in _BUILT]
        needed = [n for n in needed if n not in built]
        bases = {b for n in [*needed, name] for b in _DEPENDS[n] if b in TABLES}
        ctes = []
        for b in [*sorted(bases), *built]:  # views of names of their own, so that the caller's stay as they are
            view = f"arborist_{b}_{hashlib.md5(self.sf_dir.encode()).hexdigest()}"
            (self.lazy(b) if b in built else self[b]).createOrReplaceTempView(view)
            ctes.append(f"{b} AS (SELECT * FROM {view})")
        ctes += [f"{n} AS ({self._sql[n]})" for n in needed]
        return self.spark.sql(f"WITH {', '.join(ctes)} {self._sql[name]}")

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            df = self.lazy(name)
            path = f"{shared_root(self.spark)}/derived-{name}-{uuid.uuid4().hex}"
            with sorted_aggregates(self.spark):
                df.write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])
