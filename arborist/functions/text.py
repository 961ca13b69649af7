"""Text functions: tokens, fuzzy scores, snippets, digests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")), F.lit(0))


def search_tokens(c: Column) -> Column:
    """Distinct lower-cased tokens of at least two characters."""
    clean = F.regexp_replace(F.lower(c), r"[^a-z0-9\s_-]", " ")
    return F.array_distinct(F.filter(F.split(clean, r"[\s_-]+"), lambda t: F.length(t) >= 2))


def query_tokens(query: str) -> list[str]:
    """`search_tokens` for a query given by the caller."""
    clean = re.sub(r"[^a-z0-9\s_-]", " ", query.lower())
    return list(dict.fromkeys(t for t in re.split(r"[\s_-]+", clean) if len(t) >= 2))


def edit_distance(a: Column, b: Column, limit: int | None = None) -> Column:
    """Levenshtein distance; -1 above `limit`."""
    return F.levenshtein(a, b, limit) if limit is not None else F.levenshtein(a, b)


def fuzzy_words(c: Column) -> Column:
    """Distinct words a fuzzy match looks at (input is lower case)."""
    return F.array_distinct(F.filter(F.split(c, "[^a-z0-9]+"), lambda w: F.length(w) >= 2))


def fuzzy_word_score(token: str, words: Column) -> Column:
    """Best `(len - distance) * 1.5` over words within the distance allowed for the token."""
    limit = 2 if len(token) >= 5 else 1
    near = F.filter(words, lambda w: F.abs(F.length(w) - len(token)) <= limit)
    dist = F.array_min(
        F.filter(F.transform(near, lambda w: F.levenshtein(F.lit(token), w, limit)), lambda d: d >= 0)
    )
    return F.coalesce((F.lit(len(token)) - dist) * 1.5, F.lit(0.0))


def _close_words(token: str, words: Column) -> Column:
    limit = 2 if len(token) >= 5 else 1
    return F.filter(words, lambda w: F.levenshtein(F.lit(token), w, limit) >= 0)


def is_subsequence(query: str, name: Column) -> Column:
    """All characters of the query appear in order in the name."""
    return name.rlike("(?s)" + ".*".join(re.escape(ch) for ch in query))


def snippet(text: Column, query: str) -> Column:
    """Window of 90 characters before and 140 after the first hit, escaped, hit marked."""
    phrase = query.strip().lower()
    tokens = query_tokens(query)
    low = F.lower(text)
    at = F.lit(0)
    size = F.lit(0)
    if len(phrase) >= 2:
        at = F.locate(phrase, low)
        size = F.lit(len(phrase))
    for_tokens = F.lit(0)
    token_len = F.lit(0)
    for t in tokens:
        pos = F.locate(t, low)
        better = (pos > 0) & ((for_tokens == 0) | (pos < for_tokens))
        token_len = F.when(better, F.lit(len(t))).otherwise(token_len)
        for_tokens = F.when(better, pos).otherwise(for_tokens)
    size = F.when(at > 0, size).otherwise(token_len)
    at = F.when(at > 0, at).otherwise(for_tokens)
    # Fuzzy fallback: the closest word stands in for the hit.
    fuzzy_at, fuzzy_len = F.lit(0), F.lit(0)
    for t in reversed(tokens):
        word = F.get(_close_words(t, fuzzy_words(low)), F.lit(0))
        fuzzy_len = F.when(word.isNotNull(), F.length(word)).otherwise(fuzzy_len)
        fuzzy_at = F.when(word.isNotNull(), F.position(word, low)).otherwise(fuzzy_at)
    size = F.when(at > 0, size).otherwise(fuzzy_len)
    at = F.when(at > 0, at).otherwise(fuzzy_at)

    start = F.greatest(at - 90, F.lit(1))
    end = F.least(F.length(text) + 1, at + size + 140)
    ell = F.lit("\u2026")

    def esc(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def styled(c: Column) -> Column:
        c = F.regexp_replace(c, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
        c = F.regexp_replace(c, r"\*(.+?)\*", "<em>$1</em>")
        c = F.regexp_replace(c, r"`([^`]+)`", "<code>$1</code>")
        return F.regexp_replace(c, r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2" style="color:inherit">$1</a>')

    before = F.regexp_replace(F.substring(text, start, at - start), r"^\s+", "")
    hit = F.substring(text, at, size)
    after = F.regexp_replace(F.substring(text, at + size, end - at - size), r"\s+$", "")
    marked = F.concat(
        F.when(start > 1, ell).otherwise(F.lit("")),
        styled(esc(before)),
        F.lit("<mark>"),
        esc(hit),
        F.lit("</mark>"),
        styled(esc(after)),
        F.when(end <= F.length(text), ell).otherwise(F.lit("")),
    )
    plain = F.concat(
        styled(esc(F.regexp_replace(F.substring(text, 1, 220), r"^\s+|\s+$", ""))),
        F.when(F.length(text) > 220, ell).otherwise(F.lit("")),
    )
    return F.when(at > 0, marked).otherwise(plain)


def definition_hash(name: Column, kind: Column, line: Column, end_line: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", name, kind, line, end_line)), 1, 12)


#: A lane is so many hex digits of an item's hash; their sums make up a set's digest.
LANE_DIGITS, LANES = 15, 4


def lane_digest(items: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Digest of the items of each group, whatever their order: keys, digest, n_items.

    Every item is hashed, the hash is cut into lanes, each lane is summed, and
    the count and the sums are hashed.  It is one aggregation with partial sums
    at any size: no list, no sort, nothing that a hot group could overflow.
    """
    h = F.sha2(F.col(item), 256)
    lane = lambda k: F.conv(F.substring(h, 1 + k * LANE_DIGITS, LANE_DIGITS), 16, 10).cast("decimal(20,0)")
    sums = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), *[F.sum(lane(k)).alias(f"_lane{k}") for k in range(LANES)])
    digest = F.sha2(F.concat_ws(":", "n_items", *[F.col(f"_lane{k}").cast("string") for k in range(LANES)]), 256)
    return sums.select(*keys, digest.alias("digest"), "n_items")


def sql_lane_digest(item: str) -> str:
    """`lane_digest` of the rows of a group, as DuckDB SQL."""
    lane = lambda k: f"CAST(sum(CAST(concat('0x', substring(sha256({item}), {1 + k * LANE_DIGITS}, {LANE_DIGITS})) AS BIGINT)) AS VARCHAR)"
    return f"sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {', '.join(lane(k) for k in range(LANES))}))"
