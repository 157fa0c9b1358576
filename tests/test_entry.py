import __spark_entry__ as entry

SMOKE = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
