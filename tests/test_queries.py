"""Every query of the base registry against its DuckDB SQL."""

import compare
import pytest

from cuewright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    got = compare.spark_rows(registry.QUERIES[name](spark, SF))
    want = compare.duck(SF, registry.ORACLE_SQL[name])
    assert got == want


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dispatch_pushes_filters_and_does_not_shuffle_events(spark):
    plan = registry.QUERIES["macro_dispatch"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "ReadSchema: struct<event_id" in plan and "ts" not in plan.split("ReadSchema: struct<event_id")[1].split(">")[0]
