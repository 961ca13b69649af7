"""Projects that a task works on whole give what the rounds give."""

import random

import pytest

from arborist.operators import traverse as t


def some_edges(spark, seed, sizes=(("p", 14, 26), ("q", 40, 60), ("r", 60, 40)), odd=True):
    """Random graphs with repeated edges, edges of a file to itself, and ends that are missing."""
    rng = random.Random(seed)
    rows = [(p, f"n{rng.randrange(n)}é", f"n{rng.randrange(n)}é", []) for p, n, m in sizes for _ in range(m)]
    if odd:
        rows += rows[:5] + [("p", None, "n1é", []), ("q", "n2é", None, []), ("q", "n3é", "n3é", []), (None, "n1é", "n2é", []), ("o", None, None, [])]
    return spark.createDataFrame(rows, "project string, src string, dst string, imports array<string>")


def some_nodes(spark, edges):
    ends = {(r["project"], f) for r in edges.collect() for f in (r["src"], r["dst"])} | {("p", "alone"), ("s", "other"), ("q", None), (None, "n1é")}
    return spark.createDataFrame(sorted(ends, key=str), "project string, file string")


def told(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture
def no_rounds(monkeypatch):
    """From its first call on, a round fails."""

    def stop():
        monkeypatch.setattr(t._Latest, "put", lambda self, df: pytest.fail("a round"))
        monkeypatch.setattr(t._Levels, "add", lambda self, df: pytest.fail("a round"))

    return stop


def test_communities_of_small_projects_need_no_round(spark, no_rounds):
    e = some_edges(spark, 1)
    n = some_nodes(spark, e)
    by_rounds = told(t.community_members(n, e, 0.7, rounds=33))
    assert told(t.community_members(n, e, 0.7, rounds=33, small=45)) == by_rounds
    no_rounds()
    assert told(t.community_members(n, e, 0.7, rounds=33, small=t.SMALL)) == by_rounds and len({c for c, *_ in by_rounds}) < len(by_rounds)


def test_a_tour_of_small_projects_needs_no_round(spark, no_rounds):
    e = some_edges(spark, 3, (("p", 40, 30), ("q", 40, 60), ("r", 90, 40)))
    n = some_nodes(spark, e)
    by_rounds = told(t.guided_tour(n, e))
    assert told(t.guided_tour(n, e, small=80)) == by_rounds
    no_rounds()
    assert told(t.guided_tour(n, e, small=t.SMALL)) == by_rounds
    assert {r for _, _, _, r in by_rounds} >= {"dependency", "entry point", "in cycle"} and len({d for d, *_ in by_rounds}) > 3
    # files that no edge can name are read at once
    assert (0, "n1é", None, "entry point") in by_rounds and (0, None, "q", "entry point") in by_rounds


def test_paths_of_small_projects_need_no_round(spark, no_rounds):
    """All pairs of files: of the same length, of no way, of a file and itself, and in a project of many pairs."""
    e = some_edges(spark, 5, (("p", 9, 26), ("q", 12, 20), ("r", 5, 5)))
    n = some_nodes(spark, e)
    pairs = n.withColumnRenamed("file", "src").join(n.withColumnRenamed("file", "dst"), "project").where("project <> 'q' OR dst < 'n3'")
    by_rounds = told(t.shortest_path(e, pairs))
    assert told(t.shortest_path(e, pairs, small=90)) == by_rounds
    no_rounds()
    assert told(t.shortest_path(e, pairs, small=t.SMALL)) == by_rounds and {n for _, n, *_ in by_rounds} >= {0, 1, 2, 3}
    # what takes more searches than a task may do goes by rounds
    with pytest.raises(pytest.fail.Exception, match="a round"):
        t.shortest_path(e, pairs, small=t.SMALL // 512)


def test_components_and_cycles_of_small_projects_need_no_round(spark, no_rounds):
    e = some_edges(spark, 7, (("p", 14, 26), ("q", 40, 55), ("r", 30, 33)))
    by_rounds = told(t.cyclic_components(e)), told(t.cycles(e))
    assert (told(t.cyclic_components(e, 45)), told(t.cycles(e, 45))) == by_rounds
    no_rounds()
    assert (told(t.cyclic_components(e, t.SMALL)), told(t.cycles(e, t.SMALL))) == by_rounds
    assert len({c[0] for c in by_rounds[0]}) > 2 and len({n for _, n, _ in by_rounds[1]}) > 2
