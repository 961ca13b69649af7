"""Extraction from source text: imports, exports and routes.

Statements come from the scanner (`scan`), which leaves comments and quoted text
out; a handful of native regular expressions per language read them.  Patterns
are data (`Rule` tables), so a caller can pass more of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborist.functions.paths import resolve_relative, trimmed
from arborist.operators.scan import statements

# ---- imports --------------------------------------------------------------------


def _items(text: Column, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, sep), trimmed), lambda t: t != "")


def _import(source: Column, specs: Column, default: Column | None = None, namespace: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        source.alias("source"),
        specs.alias("specifiers"),
        (default if default is not None else null).alias("default_name"),
        (namespace if namespace is not None else null).alias("namespace"),
    )


def _empty() -> Column:
    return F.array().cast("array<string>")


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _script_imports(s: Column) -> Column:
    head = r"^\s*import\s+(?:type\s+)?"
    named = F.regexp_extract(s, head + r"[^'\"]*?\{([^}]*)\}", 1)
    specs = F.transform(
        _items(named), lambda t: F.regexp_extract(F.regexp_replace(t, r"^type\s+", ""), r"^([\w$]+)", 1)
    )
    default = _some(F.regexp_extract(s, head + r"([\w$]+)\s*(?:,|from\b)", 1))
    namespace = _some(F.regexp_extract(s, r"\*\s+as\s+([\w$]+)", 1))
    source = F.regexp_extract(s, r"^\s*import\s+(?:[^'\"]*?\bfrom\s*)?[\"']([^\"']+)[\"']", 1)
    es = F.when(source != "", F.array(_import(source, specs, default, namespace)))
    calls = F.transform(
        F.regexp_extract_all(s, F.lit(r"(?<![\w$.])require\(\s*[\"']([^\"']+)[\"']"), F.lit(1)),
        lambda m: _import(m, _empty()),
    )
    return F.when(source != "", es).otherwise(calls)


def _python_imports(s: Column) -> Column:
    plain = F.regexp_extract(s, r"^\s*import\s+([^#;]+)", 1)
    whole = F.transform(
        _items(plain),
        lambda t: _import(
            F.regexp_extract(t, r"^([\w.]+)", 1),
            F.array(
                F.when(t.rlike(r"\sas\s"), F.regexp_extract(t, r"\sas\s+(\w+)", 1)).otherwise(
                    F.regexp_extract(t, r"^(\w+)", 1)
                )
            ),
        ),
    )
    source = F.regexp_extract(s, r"^\s*from\s+([.\w]+)\s+import\b", 1)
    names = F.regexp_extract(s, r"^\s*from\s+[.\w]+\s+import\s*\(?([^)#;]*)", 1)
    specs = F.when(trimmed(names) == "*", _empty()).otherwise(
        F.transform(_items(names), lambda t: F.element_at(F.split(F.regexp_extract(t, r"^([\w.]+)", 1), r"\."), -1))
    )
    return F.when(source != "", F.array(_import(source, specs))).when(plain != "", whole)


def _go_imports(s: Column) -> Column:
    # alias and path travel as one text, "alias path"
    specs = F.when(
        s.rlike(r"^\s*import\b"),
        F.regexp_extract_all(s, F.lit(r"((?:[\w.]+\s+)?[\"`][^\"`]+[\"`])"), F.lit(1)),
    )

    def one(t: Column) -> Column:
        source = F.regexp_extract(t, r"[\"`]([^\"`]+)[\"`]", 1)
        alias = F.regexp_extract(F.regexp_replace(t, r"^import\s+", ""), r"^([\w.]+)\s+[\"`]", 1)
        return _import(source, F.array(F.when(alias != "", alias).otherwise(F.substring_index(source, "/", -1))))

    return F.transform(specs, one)


def _rust_imports(s: Column) -> Column:
    text = F.regexp_extract(s, r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+(?:::\*)?)\s*;", 1)
    wild = text.endswith("::*")
    crate = F.regexp_extract(s, r"^\s*extern\s+crate\s+(\w+)", 1)
    used = _import(
        F.regexp_replace(text, r"::\*$", ""), F.when(wild, _empty()).otherwise(F.array(F.element_at(F.split(text, "::"), -1)))
    )
    return F.when(text != "", F.array(used)).when(crate != "", F.array(_import(crate, F.array(crate))))


def _dotted_imports(s: Column, pattern: str, wild_end: str) -> Column:
    text = F.regexp_extract(s, pattern, 1)
    wild = text.endswith(wild_end)
    source = F.when(wild, F.substring(text, F.lit(1), F.length(text) - len(wild_end))).otherwise(text)
    specs = F.when(wild, _empty()).otherwise(F.array(F.element_at(F.split(text, r"\."), -1)))
    return F.when(text != "", F.array(_import(source, specs)))


def _scala_imports(s: Column) -> Column:
    group = F.regexp_extract(s, r"^\s*import\s+[\w.]+\.\{([^}]*)\}", 1)
    picked = F.transform(
        _items(group), lambda t: _import(F.regexp_extract(t, r"^(\w+)", 1), F.array(F.regexp_extract(t, r"^(\w+)", 1)))
    )
    return F.when(group != "", picked).otherwise(_dotted_imports(s, r"^\s*import\s+([\w.]+(?:\._)?)\s*;?\s*$", "._"))


def extract_imports(source_files: DataFrame) -> DataFrame:
    """Import rows of eight languages: source, names, default, namespace, resolved path, line."""
    st = statements(source_files)
    s, lang = F.col("stmt"), F.col("language")
    found = (
        F.when(lang.isin("javascript", "typescript"), _script_imports(s))
        .when(lang == "python", _python_imports(s))
        .when(lang == "go", _go_imports(s))
        .when(lang == "rust", _rust_imports(s))
        .when(lang == "java", _dotted_imports(s, r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", ".*"))
        .when(lang == "kotlin", _dotted_imports(s, r"^\s*import\s+(\w+(?:\.\w+)*(?:\.\*)?)", ".*"))
        .when(lang == "scala", _scala_imports(s))
    )
    # cheap test first, so most lines never reach the full expression
    likely = s.rlike(r"\b(import|require|use|extern|from)\b")
    rows = st.where(likely).select("project", "file", "language", "line", F.inline(found))
    resolved = F.when(lang.isin("javascript", "typescript"), resolve_relative(F.col("file"), F.col("source")))
    return rows.select(
        "project", "file", "source", "specifiers", "default_name", "namespace", resolved.alias("resolved"), "line"
    )


# ---- exports ----------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A line pattern: languages, expression, group holding the name, kind of symbol."""

    languages: tuple[str, ...]
    pattern: str
    kind: str
    group: int = 1


_SCRIPT = ("javascript", "typescript")
_JVM = r"^\s*(?:@\w+\s+)*public\s+(?:(?:static|final|abstract|sealed|strictfp)\s+)*"
_KT = r"^\s*(?:public\s+)?(?:(?:data|sealed|open|abstract|inline|suspend|override|const|lateinit|operator|infix|inner|value|tailrec)\s+)*"
_SC = r"^\s*(?:(?:final|sealed|abstract|implicit|lazy|case|override|inline|transparent|open)\s+)*"
_RS = r"^\s*pub(?:\([^)]*\))?\s+"

EXPORT_RULES: list[Rule] = [
    Rule(_SCRIPT, r"^\s*export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)", "function"),
    Rule(_SCRIPT, r"^\s*export\s+(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)", "class"),
    Rule(_SCRIPT, r"^\s*export\s+(?:default\s+)?interface\s+([\w$]+)", "interface"),
    Rule(_SCRIPT, r"^\s*export\s+type\s+([\w$]+)\s*[=<]", "type"),
    Rule(_SCRIPT, r"^\s*export\s+(?:const\s+)?enum\s+([\w$]+)", "enum"),
    Rule(("javascript",), r"^\s*(?:module\.)?exports\.([\w$]+)\s*=[^=]", "variable"),
    Rule(("javascript",), r"^\s*module\.(exports)\s*=[^=]", "variable"),
    Rule(("python",), r"^(?:async\s+)?def\s+([A-Za-z]\w*)", "function"),
    Rule(("python",), r"^class\s+([A-Za-z]\w*)", "class"),
    Rule(("python",), r"^([A-Za-z][\w.]*(?:\s*,\s*\w+)*)\s*(?::[^=]+)?=[^=]", "variable"),
    Rule(("go",), r"^func\s+([A-Z]\w*)\s*[\[(]", "function"),
    Rule(("go",), r"^type\s+([A-Z]\w*)\s+interface\b", "interface"),
    Rule(("go",), r"^type\s+([A-Z]\w*)\s+(?!interface\b)\S", "class"),
    Rule(("go",), r"^(?:var|const)\s+([A-Z]\w*)\b", "variable"),
    Rule(("rust",), _RS + r"(?:(?:async|unsafe|const|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)", "function"),
    Rule(("rust",), _RS + r"struct\s+(\w+)", "class"),
    Rule(("rust",), _RS + r"enum\s+(\w+)", "enum"),
    Rule(("rust",), _RS + r"(?:unsafe\s+)?trait\s+(\w+)", "interface"),
    Rule(("rust",), _RS + r"type\s+(\w+)", "type"),
    Rule(("rust",), _RS + r"(?:const|static(?:\s+mut)?)\s+(\w+)\s*:", "variable"),
    Rule(("java",), _JVM + r"(?:class|record)\s+(\w+)", "class"),
    Rule(("java",), _JVM + r"interface\s+(\w+)", "interface"),
    Rule(("java",), _JVM + r"enum\s+(\w+)", "enum"),
    Rule(("kotlin",), _KT + r"enum\s+class\s+(\w+)", "class"),
    Rule(("kotlin",), _KT + r"(?:class|object)\s+(\w+)", "class"),
    Rule(("kotlin",), _KT + r"(?:fun\s+)?interface\s+(\w+)", "interface"),
    Rule(("kotlin",), _KT + r"fun\s+(?:<[^>]*>\s+)?(?:[\w<>?]+\.)?(\w+)\s*\(", "function"),
    Rule(("kotlin",), _KT + r"va[lr]\s+(\w+)", "variable"),
    Rule(("scala",), _SC + r"(?:class|object)\s+(\w+)", "class"),
    Rule(("scala",), _SC + r"trait\s+(\w+)", "interface"),
    Rule(("scala",), _SC + r"enum\s+(\w+)", "enum"),
    Rule(("scala",), _SC + r"def\s+(\w+)", "function"),
    Rule(("scala",), _SC + r"va[lr]\s+(\w+)", "variable"),
]
# `export const x = ...` has no name of its own in the published analysis, so it
# is reported only on request.
LEXICAL_RULES: list[Rule] = [Rule(_SCRIPT, r"^\s*export\s+(?:const|let|var)\s+(?!enum\b)([\w$]+)", "variable")]


def extract_exports(source_files: DataFrame, lexical: bool = False, rules: Sequence[Rule] = tuple(EXPORT_RULES)) -> DataFrame:
    """Public symbols (project, file, name, kind, line) by the rules of each language."""
    st = statements(source_files)
    s, lang = F.col("stmt"), F.col("language")
    entry = "array<struct<name:string,kind:string>>"
    out = F.when(F.lit(False), F.array().cast(entry))
    for r in [*rules, *(LEXICAL_RULES if lexical else [])]:
        name = F.regexp_extract(s, r.pattern, r.group)
        hit = lang.isin(*r.languages) & s.rlike(r.pattern)
        out = out.when(hit, F.array(F.struct(name.alias("name"), F.lit(r.kind).alias("kind"))))
    clause = F.regexp_extract(s, r"^\s*export\s+(?:type\s+)?\{([^}]*)\}", 1)
    listed = F.transform(
        _items(clause),
        lambda t: F.struct(F.regexp_extract(t, r"^(?:type\s+)?([\w$]+)", 1).alias("name"), F.lit("variable").alias("kind")),
    )
    out = out.when(lang.isin(*_SCRIPT) & (clause != ""), listed)
    likely = s.rlike(r"\b(export|exports|pub|public)\b") | lang.isin("python", "go", "kotlin", "scala")
    hidden = lang.isin("kotlin", "scala") & s.rlike(r"\b(private|protected|internal)\b")
    found = st.where(likely & ~hidden).select("project", "file", "language", "line", F.inline(out)).where("name <> '__all__'")
    # Python: __all__, where given, is the list of public names
    allowed = (
        st.where((lang == "python") & s.rlike(r"^__all__\s*=\s*\["))
        .select("project", "file", F.explode(F.regexp_extract_all(s, F.lit(r"[\"']([^\"']*)[\"']"), F.lit(1))).alias("name"))
        .distinct()
    )
    listing = allowed.select("project", "file").distinct().withColumn("listing", F.lit(True))
    cols = ["project", "file", "name", "kind", "line"]
    python = found.where(lang == "python")
    kept = (
        python.join(listing, ["project", "file"], "left")
        .join(allowed.withColumn("listed", F.lit(True)), ["project", "file", "name"], "left")
        .where("listing IS NULL OR listed")
    )
    return found.where(lang != "python").select(*cols).unionByName(kept.select(*cols))


# ---- routes -------------------------------------------------------------------------


@dataclass(frozen=True)
class RouteRule:
    """Web framework pattern: file-name test, expression on one line, groups of method / path / handler.

    A call names its handler itself; a decorator's is the next definition.
    """

    framework: str
    files: str
    pattern: str
    method: int | None
    path: int
    handler: int | None
    path_prefix: str = ""
    default_handler: str = "anonymous"
    decorator: bool = False


_STR = r"[\"']([^\"']+)[\"']"
# Frameworks, their calls and decorators, and HTTP verbs.
ROUTE_RULES: list[RouteRule] = [
    RouteRule(
        "express",
        r"\.(js|ts|mjs|cjs)$",
        r"\.(get|post|put|patch|delete|all|options|head)\s*\(\s*[\"']([^\"']*)[\"']\s*(?:,\s*(?:[\w$]+\.)*([\w$]+)\s*[,)])?",
        1,
        2,
        3,
    ),
    RouteRule("django", r"urls\.py$", r"(?<![\w.])(?:path|re_path|url)\(\s*r?[\"']([^\"']*)[\"']\s*,\s*([\w.]+)", None, 1, 2, "/", "unknown"),
    RouteRule("flask", r"\.py$", rf"^\s*@(?:app|bp|blueprint)\.(route|get|post|put|patch|delete)\(\s*{_STR}", 1, 2, None, decorator=True),
    RouteRule("fastapi", r"\.py$", rf"^\s*@(?:app|router)\.(get|post|put|patch|delete)\(\s*{_STR}", 1, 2, None, decorator=True),
    RouteRule("spring", r"\.java$", rf"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?{_STR}", 1, 2, None, decorator=True),
    RouteRule("nestjs", r"\.ts$", rf"@(Get|Post|Put|Delete|Patch|All)\(\s*{_STR}", 1, 2, None, decorator=True),
    RouteRule("gin", r"\.go$", r"\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*\(\s*\"([^\"]*)\"", 1, 2, None, "", "handler"),
]

_DECORATORS = r"^\s*(?:@[\w.]+(?:\([^)]*\))?\s*)+"
_NOT_A_NAME = r"(?!(?:return|new|throw|else|if|for|while|switch|catch|await|super|assert|do|try)\b)"
# Definitions by file type: name of a method or function; classes apart.
_DEFINES = {
    r"\.py$": r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)",
    r"\.java$": rf"^\s*{_NOT_A_NAME}(?:[\w<>\[\],.?]+\s+)+(\w+)\s*\(",
    r"\.ts$": rf"^\s*(?:(?:async|public|private|protected|static|override)\s+)*{_NOT_A_NAME}(\w+)\s*[(<]",
}
_CLASS = r"^\s*(?:(?:export|default|abstract|public|private|protected|static|final|sealed)\s+)*(?:class|interface|enum|record)\s+(\w+)"


def _routes(r: RouteRule, text: Column, handler: Column | None = None) -> Column:
    """Routes that one rule finds on a line, as an array of rows."""
    take = lambda k: F.regexp_extract_all(text, F.lit(r.pattern), F.lit(k))
    parts = F.arrays_zip(take(r.path).alias("p"), take(r.method or r.path).alias("m"), take(r.handler or r.path).alias("h"))

    def row(x: Column) -> Column:
        method = F.upper(x["m"]) if r.method else F.lit("ANY")
        named = (F.nullif(x["h"], F.lit("")) if r.handler else F.lit(None).cast("string")) if handler is None else handler
        return F.struct(
            F.when(method == "ROUTE", "ANY").otherwise(method).alias("method"),
            F.concat(F.lit(r.path_prefix), x["p"]).alias("path"),
            F.coalesce(named, F.lit(r.default_handler)).alias("handler"),
            F.lit(r.framework).alias("framework"),
        )

    return F.transform(parts, row)


def extract_routes(source_files: DataFrame, rules: Sequence[RouteRule] = tuple(ROUTE_RULES)) -> DataFrame:
    """HTTP routes of seven frameworks.  Detectors are gated by file name; a file may match several.

    A call gives a row each time it stands on a line.  A decorator is matched on
    its own line and takes its handler from the next definition, which one
    ordered pass over the decorators and definitions of the file finds; a
    Spring mapping on a class gives no row.
    """
    none = F.array().cast("array<struct<method:string,path:string,handler:string,framework:string>>")
    file, text = F.col("file"), F.col("text")
    lines = source_files.select("project", F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    out = ["project", "file", "method", "path", "handler", "line", "framework"]

    calls = [r for r in rules if not r.decorator]
    by_call = F.concat(*[F.when(file.rlike(r.files) & text.rlike(r.pattern), _routes(r, text)).otherwise(none) for r in calls]) if calls else none
    called = lines.where(text.contains("(")).select("project", "file", (F.col("pos") + 1).alias("line"), F.inline(by_call))

    decorators = [r for r in rules if r.decorator]
    if not decorators:
        return called.select(*out)
    bare = F.regexp_replace(text, _DECORATORS, "")
    in_class = F.nullif(F.regexp_extract(bare, _CLASS, 1), F.lit(""))
    name = F.lit(None).cast("string")
    for files, pattern in _DEFINES.items():
        name = F.when(file.rlike(files), F.nullif(F.regexp_extract(bare, pattern, 1), F.lit(""))).otherwise(name)
    defined = F.when(F.coalesce(in_class, name).isNotNull(), F.struct(F.coalesce(in_class, name).alias("name"), in_class.isNotNull().alias("is_class")))
    marked = lines.where(F.lit(False) | reduce(or_, [file.rlike(r.files) for r in decorators])).withColumn("defined", defined)
    marked = marked.where(F.col("defined").isNotNull() | text.contains("@"))
    upwards = Window.partitionBy("project", "file").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = marked.withColumn("next", F.last("defined", ignorenulls=True).over(upwards)).where(text.contains("@"))
    hits = F.concat(
        *[
            F.when(
                file.rlike(r.files) & text.rlike(r.pattern) & (F.coalesce(~F.col("next.is_class"), F.lit(False)) if r.framework == "spring" else F.lit(True)),
                _routes(r, text, F.col("next.name")),
            ).otherwise(none)
            for r in decorators
        ]
    )
    decorated = ahead.select("project", "file", (F.col("pos") + 1).alias("line"), F.inline(hits))
    return called.unionByName(decorated).select(*out)


def route_summary(routes: DataFrame) -> DataFrame:
    return routes.groupBy("project", "framework").agg(F.count(F.lit(1)).alias("routes"))
