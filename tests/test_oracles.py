"""Registered queries against their SQL on the smallest tables.

The default list is a cross-section; ARBORIST_ALL=1 runs every query.
"""

import os

import pytest

from arborist.plans.catalog import all_queries
from arborist.sources.derived import Derived
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = {
    "hotspots", "module_boundaries", "dead_exports", "layer_summary", "diagram_edges", "signature", "element_tree",
    "snapshot_diff", "coverage_map", "plan_incremental", "fingerprint_deltas", "weighted_search", "resolve_imports",
    "change_bursts", "affected_files",
}
CHOSEN = [q for q in all_queries() if os.environ.get("ARBORIST_ALL") or q.name in QUICK]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("query", CHOSEN, ids=lambda q: q.name)
def test_query(spark, con, query):
    df = query.build(Derived(spark, SF))
    sql = query.oracle()
    if sql is None:
        assert df.count() >= 0
    else:
        assert compare(df, con, sql) is None
