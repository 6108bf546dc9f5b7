"""The driver's contract."""

import __spark_entry__ as contract


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["doc_id", "html"] and frame.count() > 0


def test_oracles_name_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
