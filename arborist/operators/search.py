"""Search over documentation elements and files.

Queries come from the caller as text, so each document row tests a literal list
of them and emits only its hits; nothing is joined against the whole corpus.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.functions.common import top_n
from arborist.functions.paths import base_of, top_of
from arborist.functions.rules import FIELD_WEIGHT
from arborist.functions.text import fuzzy_word_score, fuzzy_words, is_subsequence, query_tokens, snippet

KEYS = ["project", "path"]


def fuzzy_search(elements: DataFrame, fields: DataFrame, queries: Sequence[str], limit: int = 20) -> DataFrame:
    """Tiered search: name, name contains, path contains, description contains, letters in order."""
    desc = fields.where("field = 'description'").select(*KEYS, "text")
    docs = elements.select(*KEYS).join(desc, KEYS, "left")
    name = F.lower(base_of(F.col("path")))
    low_path = F.lower("path")
    low_text = F.lower(F.coalesce("text", F.lit("")))

    def score(q: str) -> Column:
        return (
            F.when(name == q, 100)
            .when(name.contains(q), 80)
            .when(low_path.contains(q), 60)
            .when(low_text.contains(q), 40)
            .when(is_subsequence(q, name), 20)
        )

    hits = F.filter(
        F.array(*[F.struct(F.lit(q).alias("query"), score(q.lower()).alias("score")) for q in queries]),
        lambda h: h["score"].isNotNull(),
    )
    rows = docs.select(*KEYS, F.substring("text", 1, 100).alias("head"), F.inline(hits))
    best = top_n(rows, ["project", "query"], [F.desc("score"), F.asc("path")], limit)
    kind = F.when(F.col("score") == 60, "path").when(F.col("score") == 40, "description").otherwise("name")
    return best.select(
        *KEYS, "query", "score", kind.alias("match"), F.when(F.col("score") == 40, F.col("head")).alias("snippet")
    )


def parse_query(query: str) -> tuple[list[str], str, list[str]]:
    """Tokens, phrase and `tag:` filters of a query."""
    tags = [t.lower() for t in re.findall(r"tag:([\w-]+)", query.strip())]
    rest = re.sub(r"tag:([\w-]+)", "", query.strip()).strip()
    return query_tokens(rest), rest.lower(), tags


def _weight() -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELD_WEIGHT.items() for x in kv]), F.col("field"))


def weighted_search(
    fields: DataFrame, query: str, elements: DataFrame | None = None, min_score: float = 2.0, with_snippet: bool = False
) -> DataFrame:
    """Score every field text against the query; `tag:x` filters need `elements` with tags."""
    tokens, phrase, tags = parse_query(query)
    low = F.lower("text")
    words = fuzzy_words(low)
    total = F.lit(0.0)
    for t in tokens:
        total = total + F.when(low.contains(t), float(min(len(t), 12) * 2)).otherwise(fuzzy_word_score(t, words))
    if len(phrase) >= 2:
        total = total + F.when(low.contains(phrase), float(len(phrase) * 3)).otherwise(0.0)
    docs = fields.where(F.col("text").rlike(r"\S"))
    if tags and elements is not None:
        own = F.transform("tags", F.lower)
        keep = elements.where(F.forall(F.array(*[F.lit(t) for t in tags]), lambda t: F.array_contains(own, t)))
        docs = docs.join(keep.select(*KEYS), KEYS, "left_semi")
    extra = [snippet(F.col("text"), query).alias("snippet")] if with_snippet else []
    return (
        docs.withColumn("raw", total * _weight())
        .where(F.col("raw") >= min_score)
        .select(*KEYS, "field", (F.floor(F.col("raw") * 10 + 0.5) / 10).alias("score"), *extra)
    )


def search_page(hits: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of each project's ranked hits, with the project's total; limit is clamped to 1..50."""
    limit, offset = max(1, min(50, limit)), max(0, offset)
    total = hits.groupBy("project").agg(F.count(F.lit(1)).alias("total"))
    ranked = top_n(hits, ["project"], [F.desc("score"), F.asc("path"), F.asc("field")], limit + offset, rank="position")
    return ranked.where(F.col("position") > offset).join(total, "project")


def featured(elements: DataFrame, tags: Sequence[str] = (), limit: int = 20) -> DataFrame:
    """Answer to an empty query: top-level elements, or all elements carrying the tags."""
    if tags:
        own = F.transform("tags", F.lower)
        rows = elements.where(F.forall(F.array(*[F.lit(t.lower()) for t in tags]), lambda t: F.array_contains(own, t)))
        rows = rows.select(*KEYS).distinct()
    else:
        rows = elements.select("project", top_of(F.col("path")).alias("path")).distinct()
    return top_n(rows, ["project"], [F.asc("path")], limit)


# ---- ranked full text --------------------------------------------------------------

# The published Okapi constants.
BM25_K1 = 1.2
BM25_B = 0.75


def text_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def searchable_texts(elements: DataFrame, fields: DataFrame) -> DataFrame:
    """(project, doc, text): path, name and five fields of each element, one row per text."""
    names = elements.select("project", F.col("path").alias("doc"), F.concat_ws(" ", "path", base_of(F.col("path"))).alias("text"))
    bodies = fields.where(F.col("field").isin("description", "context", "concern", "todo", "note"))
    return names.unionByName(bodies.select("project", F.col("path").alias("doc"), "text"))


def file_texts(files: DataFrame, definitions: DataFrame, language: Column) -> DataFrame:
    """(project, doc, text) of the file index: path and language, then one row per definition."""
    heads = files.select("project", F.col("path").alias("doc"), F.concat_ws(" ", "path", language).alias("text"))
    defs = definitions.select("project", F.col("file").alias("doc"), F.concat_ws(" ", "kind", "name").alias("text"))
    return heads.unionByName(defs)


def build_postings(texts: DataFrame) -> DataFrame:
    """Inverted index: (project, doc, term, tf)."""
    return (
        texts.select("project", "doc", F.explode(text_tokens(F.col("text"))).alias("term"))
        .groupBy("project", "doc", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def doc_lengths(texts: DataFrame) -> DataFrame:
    """(project, doc, dl), from token counts; no token leaves its row."""
    return texts.groupBy("project", "doc").agg(F.sum(F.size(text_tokens(F.col("text")))).alias("dl"))


def bm25_search(postings: DataFrame, lengths: DataFrame, queries: Sequence[str], limit: int = 20) -> DataFrame:
    """Best documents holding all terms of each query, ranked by BM25 within the project.

    Only postings of the asked terms are read.
    """
    terms = {q: list(dict.fromkeys(t for t in re.split(r"[^\w]+|_", q.lower()) if t)) for q in queries}
    asked = sorted({t for ts in terms.values() for t in ts})
    hits = postings.where(F.col("term").isin(*asked))
    df = hits.groupBy("project", "term").agg(F.count(F.lit(1)).alias("df"))
    stats = lengths.groupBy("project").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))
    scored = (
        hits.join(df.join(stats, "project"), ["project", "term"])
        .join(lengths, ["project", "doc"])
        .withColumn("part", idf * F.col("tf") * (BM25_K1 + 1) / norm)
    )
    wanted = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(q).alias("query"), F.lit(len(ts)).alias("need"), F.array(*[F.lit(t) for t in ts]).alias("ts")
                )
                for q, ts in terms.items()
                if ts
            ]
        ),
        lambda w: F.array_contains(w["ts"], F.col("term")),
    )
    per = (
        scored.select("project", "doc", "part", F.inline(wanted))
        .groupBy("project", "query", "need", "doc")
        .agg(F.count(F.lit(1)).alias("have"), F.round(F.sum("part"), 6).alias("score"))
        .where("have = need")
        .select("project", "query", "doc", "score")
    )
    return top_n(per, ["project", "query"], [F.desc("score"), F.asc("doc")], limit, rank="position")


