import os

import pytest

import __spark_entry__ as entry


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="test tables are absent")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
