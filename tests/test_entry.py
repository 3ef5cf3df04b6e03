"""The driver's contract."""

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 40


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
