"""Every registered query against its SQL, and the contract's own shape."""

import pytest

from skein.plans import catalog
from tests.compare import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert rows_of(catalog.QUERIES[name](spark, SF)) == rows_of_sql(catalog.ORACLES[name], SF)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["vector_topk", "doc_clean_text"])
def test_scans_read_only_what_they_need(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan.split("ReadSchema")[1] and "label" not in plan.split("ReadSchema")[1]
