"""Registered queries against the SQL that they are compared with."""

import duckdb
import pytest

import __spark_entry__ as entry

SMOKE = "/root/testdata/sf0.001"


def same(spark, name: str) -> None:
    from pathlib import Path

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SMOKE).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SMOKE).select(*[f"`{c[0]}`" for c in want.description])
    key = lambda r: [(x is None, str(type(x)), x) for x in r]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["stream_window_counts"])
def test_query(spark, name):
    same(spark, name)


def test_array_sizes_need_no_values_of_the_elements(spark, monkeypatch):
    from loomwork.operators import profile as P

    for step in ("_formats", "_distinct", "_options", "_shapes"):
        monkeypatch.setattr(P, step, lambda *_: pytest.fail("more than sizes was asked for"))
    same(spark, "prof_array_cardinality")
