"""Periodic runs against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborist.llm.queries import SQL_OP11, op11_periodic_runs
from arborist.llm.runs import analyse, lyndon_lengths, periodic_runs, repeated_stretches, runs_of
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "id LONG, text STRING"


def plain_lyndon(keys, inverse):
    keys = [-k for k in keys] if inverse else list(keys)
    out = []
    for i in range(len(keys)):
        j = i + 1
        while j < len(keys) and not keys[j:] < keys[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(words, shortest):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


few_words = st.lists(st.integers(0, 3), max_size=40)
periodic = st.builds(lambda a, p, k, b: a + p * k + b, few_words, st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(0, 9), few_words)


@settings(max_examples=300, deadline=None)
@given(few_words | periodic)
def test_lyndon_arrays_and_runs(words):
    for inverse in (False, True):
        assert lyndon_lengths(words, inverse) == plain_lyndon(words, inverse)
    for shortest in (1, 5, 12):
        assert runs_of(np.array(words, dtype=np.int64), shortest) == plain_runs(words, shortest)


@settings(max_examples=100, deadline=None)
@given(st.lists(few_words | periodic, max_size=4), st.sampled_from([2, 7, 12]))
def test_texts_are_collapsed(texts, shortest):
    coded = [b" ".join(b"w%d" % w for w in words) for words in texts]
    for text, (size, runs, kept) in zip(coded, analyse(coded, shortest), strict=True):
        words = text.split()
        assert size == len(words)
        assert runs == plain_runs(words, shortest)
        assert kept == plain_collapse(words, runs)


def test_stretches_stay_within_a_text():
    words, text_of = np.array([1, 2, 3, 1, 2, 3]), np.array([0, 0, 0, 1, 1, 1])
    assert repeated_stretches(words, text_of, 3) == []
    assert repeated_stretches(words, np.zeros(6, dtype=np.int64), 3) == [(0, 6)]


def test_rows_of_every_kind(spark):
    line = "the same line of text again éà\n"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, line * 3), (4, line * 3), (None, "a " * 12), (5, "a " * 11), (6, "x y " * 30000)]
    got = {}
    for r in periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.id, []).append(([tuple(s) for s in r.runs], r.n_words, r.collapsed))
    assert got[1] == got[2] == got[3] == [([], 0, "")]
    assert got[4] == [([(0, 21, 7)], 21, line.strip())] * 2
    assert got[None] == [([(0, 12, 1)], 12, "a")]
    assert got[5] == [([], 11, " ".join("a" * 11))]
    assert got[6] == [([(0, 30000, 1)], 30000, "x y")]


def test_other_columns_and_empty_tables(spark):
    clash = spark.createDataFrame([(1, "b " * 12, "kept", 7)], "id LONG, text STRING, runs STRING, n_words INT")
    row = periodic_runs(clash).first()
    assert (row["runs"], row["n_words"], row["_n_words"], [tuple(s) for s in row["_runs"]], row["collapsed"]) == ("kept", 7, 12, [(0, 12, 1)], "b")
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_query_against_sql(spark, sf):
    assert compare(op11_periodic_runs(spark, sf), connect(sf), SQL_OP11) is None
