"""Spelling variants: words that differ by one edit, grouped under their frequent forms.

Pairs are found by asymmetric q-chunks.  Of two words, the one that is shorter
(or first, of equal length) contributes two disjoint chunks, its halves; the
other contributes its positional grams of the halves' lengths.  One edit leaves
one half whole, and moves it by one place at most, so only grams within a shift
of one can meet a chunk: at place 0, and at the second half's place, moved by
the difference in length.  The edit is then in what the chunk leaves over,
which is taken apart in the same way once more.  A key is so a chunk together
with the chunk of the rest: the word without one quarter, in which the edit is.
Pairs that agree on a key are verified by their edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import fresh
from arborist.session import cut_lineage, drop_path, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where the quarters of a word of `size` letters begin: halves, and the halves' halves.
QUARTERS = ("0", "({size} div 4)", "({size} div 2)", "({size} div 2 + ({size} - {size} div 2) div 2)", "{size}")


def letter_runs(text: Column, shortest: int) -> Column:
    """Maximal runs of at least `shortest` Latin letters, A-Z in lower case; null has none."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(rf"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))


def _keys(role: str, longer: int) -> list[Column]:
    """A key for every quarter in which the edit may be; the gram side may be longer by `longer` letters."""
    size = f"(size - {longer})"
    out = []
    for k in range(4):
        begin, end = QUARTERS[k].format(size=size), QUARTERS[k + 1].format(size=size)
        rest = f"concat(substring(word, 1, {begin}), '-', substring(word, {end} + {longer} + 1))"
        out.append(F.expr(f"struct({k} AS quarter, {longer} AS longer, xxhash64({k}, {size}, {rest}) AS key)"))
    return out if role == "gram" else [F.struct(F.lit(k).alias("quarter"), c["key"].alias("key")) for k, c in enumerate(out)]


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of distinct words that differ by one inserted, deleted or replaced code point, each once.

    `words` has distinct `word`, not null, and `n`; a is the shorter word, or the first of equal length.
    """
    sized = words.select("word", "n", F.char_length("word").alias("size"))
    chunks = sized.select("*", F.explode(F.array(*_keys("chunk", 0))).alias("k"))
    grams = sized.select("*", F.explode(F.array(*_keys("gram", 0), *_keys("gram", 1))).alias("k"))
    a = chunks.select("k.key", F.col("k.quarter"), F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("size").alias("size_a"))
    b = grams.select("k.key", F.col("k.longer"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("size").alias("size_b"))
    replaced = (F.col("longer") == 0) & (F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b"))
    inserted = (F.col("longer") == 1) & (F.col("size_a") + 1 == F.col("size_b"))
    # an insertion at the begin of a quarter is also one at the end of the quarter before
    starts = [QUARTERS[k].format(size="size_a") for k in range(4)]
    begin = f"CASE quarter WHEN 1 THEN {starts[1]} WHEN 2 THEN {starts[2]} WHEN 3 THEN {starts[3]} ELSE 0 END"
    earlier = F.expr(f"longer = 1 AND quarter > 0 AND substring(a, 1 + {begin}) = substring(b, 2 + {begin})")
    met = a.join(b, "key").where(replaced | inserted)
    return met.where((F.levenshtein("a", "b", 1) == 1) & ~earlier).select("a", "n_a", "b", "n_b")


def roots(links: DataFrame, word: str, form: str) -> DataFrame:
    """(word, root): from every word that has a form, the last one reached by following forms.

    Forms must not go in circles.  Each round doubles what a link spans, so the
    number of rounds is the logarithm of the longest chain.
    """
    spark = links.sparkSession
    schema = "word STRING, root STRING"
    path = scratch(spark, "roots")
    links.select(F.col(word).alias("word"), F.col(form).alias("root")).write.parquet(path)
    while True:
        now = spark.read.schema(schema).parquet(path)
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = scratch(spark, "roots")
        now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")).write.parquet(after)
        moved = spark.read.schema(f"{schema}, moved BOOLEAN").parquet(after)
        drop_path(spark, path)
        path = after
        if moved.where("moved").isEmpty():
            return spark.read.schema(schema).parquet(path)


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """Distinct words with their near words and the form that each stands for.

    `words` has `word` and the number of its occurrences `n`; rows with a null
    in one of them take no part, other columns are left aside, and a word that
    comes more than once counts with the sum.  Returns word, n, n_near (words one
    edit away), form (the near word of largest n, ties to the first in code-point
    order, where it has `times` as many occurrences; else null), form_n, and root
    (the last word reached by following forms, the word itself without any).  An
    empty table gives an empty one.
    """
    n = F.sum("n").cast("long").alias("n")
    words = cut_lineage(words.where("word is not null and n is not null").groupBy("word").agg(n))
    pairs = near_pairs(words)
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
        )
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    frequent = -F.col("best.less") >= times * F.col("n")
    grouped = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    grouped = cut_lineage(grouped)
    ends = roots(grouped.where("form is not null"), "word", "form")
    return grouped.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def counted(df: DataFrame, word: Column) -> DataFrame:
    """(word, n): the values of a column and how often they occur; null is no word."""
    (name,) = fresh(df, "word")
    return df.select(word.alias(name)).where(F.col(name).isNotNull()).groupBy(F.col(name).alias("word")).agg(F.count(F.lit(1)).alias("n"))
