"""Walks through chains with more options than one level of their trees holds."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import text
from loomwork.operators.generate import uniform


@pytest.mark.parametrize("options", [3, 10, 30])
def test_draws_through_levels(spark, monkeypatch, options):
    """Each draw is the first option whose running count passes the row's number, at any depth; a prefix that none follows ends."""
    monkeypatch.setattr(text, "FAN", 3)
    counts = spark.createDataFrame([(["a"], f"n{i:02d}", 1 + i % 4) for i in range(options)] + [(["n00"], "a", 2)], "prefix array<string>, next string, n long")
    rows = spark.range(200).withColumn("prefix", F.array(F.lit("a")))
    got = {r.id: r.units for r in text.walk(rows, text.chain_of(counts), 2, "id", seed=5).collect()}
    upto = [sum(1 + j % 4 for j in range(i + 1)) for i in range(options)]
    for r in rows.select("id", (uniform(5, "walk.0", F.col("id")) * upto[-1]).alias("x")).collect():
        i = next(i for i, u in enumerate(upto) if u > int(r.x))
        assert got[r.id] == (["a", "n00", "a"] if i == 0 else ["a", f"n{i:02d}"])


def test_no_step_compares_all_options(spark, monkeypatch):
    monkeypatch.setattr(text, "FAN", 4)
    counts = spark.createDataFrame([(["a"], f"n{i:02d}", 1) for i in range(60)], "prefix array<string>, next string, n long")
    top, *below = text._levels(text.chain_of(counts))
    assert len(below) == 2 and all(t.agg(F.max(F.size("o"))).first()[0] <= 4 for t in (top, *below))
