"""The tables that Spark derives in a form of its own, against the SQL that says what they hold."""

import pytest

from arborist.session import sorted_aggregates
from arborist.sources.derived import Derived, Dialect, _needed, definitions

ITEM = "l_suppkey LONG, l_orderkey LONG, l_partkey LONG, l_linenumber INT, l_returnflag STRING, l_quantity DOUBLE, l_shipdate TIMESTAMP"
PART = "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Equal line items, missing names, kinds, orders and suppliers, part keys that are there twice, a part nobody has."""
    root = str(tmp_path_factory.mktemp("odd"))
    parts = [(1, "a b", "Brand#1", "PROMO", 3), (1, "c", "Brand#1", "PROMO", 3), (2, None, "Brand#2", "SMALL", 1), (3, "d", None, None, 1)]
    parts += [(k, "x y", "Brand#3", t, 5) for k, t in ((1010, "PROMO"), (1012, "STANDARD"), (7, "ECONOMY"), (8, "MEDIUM"), (9, "OTHER"), (4000, "SMALL"))]
    items = [(s, o, p, n, f) for s in (0, 5, None) for o in (0, 1, 1009, 1010, 7, None) for p in (1, 2, 3, 7, 8, 9, 1010, 1012, None) for n, f in ((1, "R"), (2, "A"), (2, "A"), (3, None))]
    spark.createDataFrame([(*i, 1.0, None) for i in items], ITEM).write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame(parts, PART).write.parquet(f"{root}/part.parquet")
    return root


@pytest.mark.parametrize("name", ["edges", "exports", "code_definitions", "old_definitions", "new_definitions", "source_files"])
def test_derived_tables_hold_what_the_sql_says(spark, odd, name):
    sql, needed = definitions(Dialect(spark=True)), _needed([name])
    tables = [f"{t} AS (SELECT * FROM parquet.`{odd}/{t}.parquet`)" for t in ("lineitem", "part")]
    want = spark.sql(f"WITH {', '.join([*tables, *(f'{n} AS ({sql[n]})' for n in needed)])} SELECT * FROM {name}")
    found = Derived(spark, odd)[name]
    assert found.dtypes == want.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["edges", "source_files"])
def test_small_groups_are_gathered_without_partial_lists(spark, odd, name):
    with sorted_aggregates(spark):
        plan = Derived(spark, odd).lazy(name)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("SortAggregate") == 1 and "collect_list" in plan


def test_pairs_of_supplier_and_part_cross_the_network_as_numbers(spark, odd):
    with sorted_aggregates(spark):
        plan = Derived(spark, odd).lazy("new_definitions")._jdf.queryExecution().executedPlan().toString()
    # no table of whole definitions is told apart: only pairs of numbers, and the parts
    assert "keys=[project" not in plan
