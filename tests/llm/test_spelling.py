"""Spelling variants against brute force."""

import random

import pytest

from arborist.llm.queries import SQL_OP12, op12_spelling_variants
from arborist.llm.spelling import counted, letter_runs, near_pairs, spelling_variants
from pyspark.sql import functions as F
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, times=10):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, x) for x, m in counts.items() if one_edit(w, x))
        form = near[0] if near and -near[0][0] >= times * n else None
        out[w] = (n, len(near), form and form[1], form and -form[0])
    for w, (n, k, form, m) in list(out.items()):
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w] = (n, k, form, m, root)
    return out


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(12)
    words = {}
    for alphabet, sizes in (("ab", (1, 9)), ("aé", (3, 12)), ("abcdé÷", (7, 9))):
        for _ in range(150):
            words["".join(rng.choice(alphabet) for _ in range(rng.randint(*sizes)))] = rng.choice([1, 2, 9, 10, 100, 100, 1000])
    for base in ("beginning", "éléphants", "aaaaaaaa", "q" * 3000):
        words[base] = 5000
        for _ in range(12):
            i, c = rng.randrange(len(base) + 1), rng.choice("aeéz")
            words.setdefault(rng.choice([base[:i] + c + base[i:], base[:i] + c + base[i + 1 :], base[:i] + base[i + 1 :]]), rng.choice([2, 499, 500, 501]))
    return words


def test_pairs_once_each(spark, vocabulary):
    got = [(r.a, r.b) for r in near_pairs(spark.createDataFrame(list(vocabulary.items()), "word STRING, n LONG")).collect()]
    words = sorted(vocabulary)
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_forms_and_roots(spark, vocabulary):
    rows = spelling_variants(spark.createDataFrame(list(vocabulary.items()), "word STRING, n LONG")).collect()
    want = plain(vocabulary)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows} == want
    assert len(rows) == len(want) and any(w[4] not in (k, w[2]) for k, w in want.items())


def test_long_chains_of_forms(spark):
    chain = {"a" * 8 + "b" * k: 10**k for k in range(12)}
    rows = spelling_variants(spark.createDataFrame(list(chain.items()), "word STRING, n LONG")).collect()
    assert {r.root for r in rows} == {"a" * 8 + "b" * 11}


def test_nulls_repeats_and_empty_tables(spark):
    schema = "word STRING, n INT, size STRING, quarter INT"
    rows = [(None, 3, "", 1), ("abcdefg", None, "", 1), ("abcdefg", 2, "x", 1), ("abcdefg", 3, "y", 2), ("abcdefh", 50, "z", 1), ("", 4, "", 1), ("a", 4, "", 1)]
    got = {r.word: (r.n, r.n_near, r.form, r.root) for r in spelling_variants(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"abcdefg": (5, 1, "abcdefh", "abcdefh"), "abcdefh": (50, 1, None, "abcdefh"), "": (4, 1, None, ""), "a": (4, 1, None, "a")}
    assert spelling_variants(spark.createDataFrame([], schema)).count() == 0


def test_letter_runs(spark):
    texts = spark.createDataFrame([("Élan-VITALE, façadeÀ× x1y straße\nœuvreeee",), (None,), ("",)], "text STRING")
    assert [r[0] for r in texts.select(letter_runs(F.col("text"), 5)).collect()] == [["vitale", "façadeÀ×", "straße", "uvreeee"], None, []]
    words = texts.select("text", F.lit(1).alias("word"))
    assert {r.word: r.n for r in counted(words, F.length("text").cast("string")).collect()} == {"41": 1, "0": 1}


def test_query_against_sql(spark):
    assert compare(op12_spelling_variants(spark, SF), connect(SF), SQL_OP12) is None
