"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

from __future__ import annotations

import pytest

from provgraph.plans import detection, features, graphs, ingest, lineage, streams

PLANS = {name: plan for module in (ingest, graphs, features, lineage, detection, streams) for name, plan in module.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in PLANS.items() if sql))
def test_against_sql(spark, small, against_sql, name):
    query, sql = PLANS[name]
    against_sql(query(spark, small), sql, small)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in PLANS.items() if not sql and n != "bounded_communities"))
def test_rows(spark, small, name):
    assert PLANS[name][0](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
