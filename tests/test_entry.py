"""The entry module: names, and the flagship query."""

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["draw", "key", "value", "weight"] and df.count() == 1000
