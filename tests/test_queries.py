"""Every query that has SQL gives the same rows as its SQL, on the smallest tables."""

from __future__ import annotations

import decimal

import duckdb
import pytest

import __spark_entry__
from siftlake.plans import registry
from siftlake.sources.readers import TABLES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    return con


def rows_of(columns, rows):
    """Rows as text, columns by name; a null is not NaN, and whole numbers are alike in any type."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda x: "null" if x is None else str(float(x)) if isinstance(x, decimal.Decimal | float) else str(x)
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, small, name):
    got, want = registry.queries()[name](spark, small), duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_items_are_not_shuffled_by_their_few_flags(spark, small):
    from siftlake.plans import measures

    plan = measures.geometry_rules(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(l_returnflag" not in plan
