"""Path functions: pieces of a path, relative imports, globs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborist.functions.rules import EXTENSION_LANGUAGE, TEST_MARKERS


def trimmed(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def base_of(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def dir_of(c: Column) -> Column:
    return F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit("."))


def stem_of(c: Column) -> Column:
    """Drop everything from the last dot."""
    return F.regexp_replace(c, r"\.[^.]+$", "")


def parent_of(c: Column) -> Column:
    """Parent path, or null at the top."""
    return F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", ""))


def depth_of(c: Column) -> Column:
    return F.size(F.split(c, "/"))


def top_of(c: Column) -> Column:
    return F.substring_index(c, "/", 1)


def normalize_path(c: Column) -> Column:
    forward = F.regexp_replace(c, r"\\", "/")
    return F.regexp_replace(F.regexp_replace(forward, r"^\./", ""), "/+$", "")


def ancestors_of(c: Column) -> Column:
    """Proper path prefixes, shortest first: a/b/c -> [a, a/b]."""
    parts = F.split(c, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def resolve_relative(origin: Column, spec: Column) -> Column:
    """Join a relative import to the importing file's directory; folds `.` and `..`."""
    start = F.filter(F.split(dir_of(origin), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        F.split(spec, "/"),
        start,
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    return F.when(spec.startswith("."), F.array_join(folded, "/")).otherwise(spec)


def extension_of(c: Column) -> Column:
    return F.regexp_extract(c, r"(\.[^.]*)$", 1)


def language_of(c: Column) -> Column:
    """Language by extension; null when the extension is not known."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair])
    return F.try_element_at(table, extension_of(c))


def is_test_file(c: Column, pattern: str | None = None) -> Column:
    """Test-file predicate; `pattern` is an unanchored expression where `*` means anything."""
    if pattern is not None:
        return c.rlike(pattern.replace("*", ".*"))
    low = F.lower(c)
    hit = F.lit(False)
    for marker in TEST_MARKERS:
        hit = hit | low.contains(marker)
    return hit


def classify_layer(c: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """First layer one of whose patterns is a substring of the lower-cased path."""
    low = F.lower(c)
    out = None
    for name, patterns in rules:
        hit = reduce(or_, [F.contains(low, F.lit(p)) for p in patterns])
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([.+^$|\\()\[\]{}])", r"\\$1")


def glob_to_regex(c: Column, braces: bool = True) -> Column:
    """Anchored regular expression of a glob, computed in the JVM.

    `*` stays inside a segment, `**` crosses segments and swallows the next
    slash, `?` is one character, `{a,b}` an alternation, `[abc]` a class.  A
    glob whose expression would not compile matches nothing.  Ignore files have
    no alternation: pass `braces=False`.
    """
    tokens = F.regexp_extract_all(c, F.lit(r"(\*\*/?|\*|\?|\{[^}]*\}|\[[^\]]*\]|[^*?{\[]+|.)"), F.lit(1))

    def piece(t: Column) -> Column:
        inner = F.regexp_replace(t, r"^.|.$", "")
        group = F.when(inner.rlike(r"(^|,)[*?]|[*?]\*"), F.lit("(?!)")).otherwise(
            F.concat(F.lit("(?:"), F.regexp_replace(_escaped(inner), ",", "|"), F.lit(")"))
        )
        klass = (
            F.when(inner == "", F.lit("(?!)"))
            .when(inner == "^", F.lit(r"[\s\S]"))
            .otherwise(F.concat(F.lit("["), F.regexp_replace(inner, r"([\[&])", r"\\$1"), F.lit("]")))
        )
        return (
            F.when(t.startswith("**"), F.lit(".*"))
            .when(t == "*", F.lit("[^/]*"))
            .when(t == "?", F.lit("[^/]"))
            .when(F.lit(braces) & t.rlike(r"^\{.*\}$"), group)
            .when(t.rlike(r"^\[.*\]$"), klass)
            .otherwise(_escaped(t))
        )

    return F.concat(F.lit("^"), F.array_join(F.transform(tokens, piece), ""), F.lit("$"))


def glob_prefix(c: Column) -> Column:
    """Literal leading directories of a glob, with the closing slash ('' when none)."""
    return F.regexp_extract(c, r"^((?:[^*?{\[/]+/)*)", 1)


def glob_extension(c: Column) -> Column:
    """Literal extension every match must have ('' when the glob does not fix one)."""
    return F.regexp_extract(c, r"(\.[A-Za-z0-9_]+)$", 1)


def path_glob_keys(c: Column) -> Column:
    """All (prefix, extension) keys a glob matching this path can carry."""
    prefixes = F.concat(F.array(F.lit("")), F.transform(ancestors_of(c), lambda p: F.concat(p, F.lit("/"))))
    exts = F.array_distinct(F.array(F.lit(""), F.regexp_extract(c, r"(\.[A-Za-z0-9_]+)$", 1)))
    return F.flatten(
        F.transform(
            prefixes, lambda p: F.transform(exts, lambda e: F.struct(p.alias("g_prefix"), e.alias("g_ext")))
        )
    )
