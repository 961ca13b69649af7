"""Statements of source text: a scanner that knows comments, strings, templates and open brackets.

A file's text is cut into lexical pieces by one regular expression per
language family, from left to right, so what begins inside a comment or a string
never counts as code.  Comments and blocks of text are blanked, with their line
breaks kept; then statements that stay open over line breaks are drawn onto their
first line, and lines are cut at semicolons outside strings.  Each step is one
pass of a possessive pattern over the text, inside the row: time grows with the
text, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.functions.paths import language_of

_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_CHARACTER = r"'(?:\\[^'\n]{1,10}+|[^'\\\n])'"
_LINE_COMMENT = r"//[^\n]*+"
_BLOCK_COMMENT = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/|/\*(?s:.*+)"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*+`|\{[^{}]*+\})*+\})*+`|`[^`]*+`"
_REGEX = r"(?<=[(,=:\[!&|?{};\n][ \t]{0,4})/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/"
_TRIPLE_DOUBLE = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""'
_TRIPLE_PLAIN = r'"""(?:[^"]|"(?!""))*+"""'
_TRIPLE_SINGLE = r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
_RAW = r'(?<![\w])r(#*+)"[\s\S]*?"\1'


@dataclass(frozen=True)
class Lexis:
    """How a language hides text: comments, texts that are blanked (they hold no path), strings that are kept; and what stays open.

    `joined` are statements that go on over line breaks.
    """

    comments: str
    blocks: str
    strings: str
    joined: str

    def pieces(self) -> str:
        """All lexical pieces; a piece of code has none of the characters that may begin another."""
        found = [p for p in (self.comments, self.blocks, self.strings) if p]
        return "|".join([*found, r"""[^/"'`#r]++|r(?![#"])[^/"'`#r]*+""", r"[\s\S]"])

    def units(self) -> str:
        """Statements that stay open, else what is up to a line break or a semicolon."""
        text = "|".join(p for p in (self.strings, r"""[^\n;"'\\]++""", r"\\\n", r"""["'\\]""") if p)
        rest = rf"(?:{text})*+[\n;]|(?:{text})++"
        return f"{self.joined}|{rest}" if self.joined else rest


_SCRIPT = Lexis(
    comments=f"{_LINE_COMMENT}|{_BLOCK_COMMENT}",
    blocks=f"{_TEMPLATE}|{_REGEX}",
    strings=f"{_DOUBLE}|{_SINGLE}",
    joined=r"[ \t]*+(?:import|export)\b(?:(?!\b(?:import|export)\b)[\w$\s,*{}])*+[\"'][^\"'\n]*+[\"']|[ \t]*+export\b(?:[ \t]++type)?\s*+\{[^{}]*+\}",
)
_JVM = Lexis(comments=f"{_LINE_COMMENT}|{_BLOCK_COMMENT}", blocks=_TRIPLE_PLAIN, strings=f"{_DOUBLE}|{_CHARACTER}", joined=r"[ \t]*+import\b[^;{}\n]*+\{[^{}]*+\}")
#: By language; a caller's own languages are further entries.
LEXIS: dict[str, Lexis] = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": _JVM,
    "kotlin": _JVM,
    "scala": _JVM,
    "python": Lexis(
        comments=r"#[^\n]*+",
        blocks=f"{_TRIPLE_DOUBLE}|{_TRIPLE_SINGLE}",
        strings=f"{_DOUBLE}|{_SINGLE}",
        joined=r"[ \t]*+(?:from[ \t]++[.\w]++[ \t]++)?import[ \t]*+\([^)]*+\)|__all__[ \t]*+=[ \t]*+\[[^\]]*+\]",
    ),
    "go": Lexis(
        comments=f"{_LINE_COMMENT}|{_BLOCK_COMMENT}",
        blocks=r"`[^`\n]*+\n[^`]*+`",
        strings=rf"{_DOUBLE}|`[^`\n]*+`|{_CHARACTER}",
        joined=r"[ \t]*+import[ \t]*+\([^)]*+\)",
    ),
    "rust": Lexis(
        comments=f"{_LINE_COMMENT}|{_BLOCK_COMMENT}",
        blocks=_RAW,
        strings=rf'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|{_CHARACTER}',
        joined=r"[ \t]*+(?:pub(?:\([^)\n]*+\))?[ \t]++)?use\b[^;\"']*+;",
    ),
}
BREAK = "\u0001"  # between statements of a line


def line_breaks(text: Column) -> Column:
    """The line breaks of a text, and nothing else."""
    return F.repeat(F.lit("\n"), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))


def code_of(content: Column, lexis: Lexis) -> Column:
    """The text with comments and blocks of text blanked, line for line; strings that hold quotes are emptied."""
    comment, block = rf"\A(?:{lexis.comments})\z", rf"\A(?:{lexis.blocks})\z"

    def shown(p: Column) -> Column:
        first = F.substring(p, 1, 1)
        if "#[^" in lexis.comments:
            begins = first == "#"
        else:
            begins = p.startswith("//") | p.startswith("/*")
        quoted = first.isin('"', "'", "`") & (F.length(p) > 2)
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        out = F.when(begins & p.rlike(comment), line_breaks(p))
        if lexis.blocks:
            blank = F.concat(F.lit('""'), line_breaks(p))
            # of the pieces that begin with a slash, code is a single one; what was before it is not seen here
            out = out.when((first == "/") & (F.length(p) > 1), blank).when(first.isin('"', "'", "`", "r") & (F.length(p) > 1) & p.rlike(block), blank)
        return out.when(quoted & inner.rlike("[\"'`]"), F.concat(F.lit('""'), line_breaks(p))).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(lexis.pieces()), F.lit(0)), shown), "")


def statement_lines(code: Column, lexis: Lexis) -> Column:
    """The code's lines, each with its statements; one that stays open is whole on its first line, and leaves empty lines behind."""

    def drawn(p: Column) -> Column:
        flat = F.regexp_replace(F.rtrim(p), r"[ \t]*\\?\n\s*", " ")
        joined = F.concat(flat, F.lit(BREAK), line_breaks(p))
        whole = F.when(p.endswith("\n"), F.when(F.instr(p, "\n") == F.length(p), p).otherwise(F.concat(flat, line_breaks(p)))).when(F.contains(p, F.lit("\n")), joined)
        return whole.when(p.endswith(";"), F.concat(p, F.lit(BREAK))).otherwise(p)

    units = F.regexp_extract_all(code, F.lit(lexis.units()), F.lit(0))
    return F.split(F.array_join(F.transform(units, drawn), ""), "\n")


def statements(source_files: DataFrame, language: Column | None = None, lexis: Mapping[str, Lexis] = LEXIS) -> DataFrame:
    """(project, file, language, line, stmt): the statements of every file, with the line they begin on.

    `language` tells a file's language, by its ending if not given; files of a
    language that `lexis` doesn't have give no rows, and neither do null texts.
    """
    files = source_files.select(
        "project", F.col("path").alias("file"), (language if language is not None else language_of(F.col("path"))).alias("language"), F.replace("content", F.lit("\r\n"), F.lit("\n")).alias("content")
    ).where(F.col("language").isin(*lexis) & F.col("content").isNotNull())
    kinds: dict[Lexis, list[str]] = {}
    for name, kind in lexis.items():
        kinds.setdefault(kind, []).append(name)

    def by_language(build) -> Column:
        out = F.when(F.lit(False), build(next(iter(kinds))))
        for kind, names in kinds.items():
            out = out.when(F.col("language").isin(*names), build(kind))
        return out

    lines = files.withColumn("code", by_language(lambda k: code_of(F.col("content"), k)))
    lines = lines.select("project", "file", "language", F.posexplode(by_language(lambda k: statement_lines(F.col("code"), k))).alias("pos", "text"))
    return lines.select("project", "file", "language", (F.col("pos") + 1).alias("line"), F.explode(F.split("text", BREAK)).alias("stmt")).where("stmt <> ''")
