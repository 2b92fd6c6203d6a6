"""Every named query against independent SQL over the same tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference

ORACLE = entry.oracle_sql()
# Correct at every scale, but the smallest tables hold no matching row.
EMPTY_WHEN_SMALL = {"tenant_reach", "peer_benchmark"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sql, small, name):
    problem = difference(entry.queries()[name](spark, small), sql, ORACLE[name])
    if name in EMPTY_WHEN_SMALL and problem == "no rows on either side":
        return
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLE)))
def test_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_entry_has_one_row_per_tenant(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 25
    assert {r.metric_key for r in rows} == {"net_profit"}
