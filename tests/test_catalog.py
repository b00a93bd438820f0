"""Every query with SQL gives the same rows as DuckDB."""

import pytest

from tests.conftest import DATA
from tidemark.plans import catalog


def normal(rows, columns):
    return sorted([tuple(None if x is None or x != x else (round(x, 5) if isinstance(x, float) else x) for x in row) for row in rows], key=lambda r: tuple(str(x) for x in r)), columns


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    found = [tuple(r) for r in frame.select(*columns).collect()]
    relation = duck.sql(catalog.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: KINDS.get(k, k) for c, k in frame.dtypes} == kinds
    wanted = relation.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert normal(found, columns) == normal(wanted, columns)


def test_entry_and_guard():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_labels_need_no_row_for_each_sample(spark):
    plan = catalog.segment_stats(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan.split("Union")[0]


def test_chain_has_few_exchanges(spark):
    plan = catalog.novelty(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["segments", "boundaries", "peaks_distance", "boundaries_2feature"])
def test_peaks_need_no_join(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and plan.count("Scan parquet") == 1
