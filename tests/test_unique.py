import re

import pytest
from pyspark.sql import functions as F

from loomwork.functions.domains import slots
from loomwork.operators import generate as G


def rows_of(spark, field, rows, name="v"):
    g = G.Generator(spark, f"schema R {{ {name}: {field} }} dataset D {{ rs: {rows} of R }}", G.Options(seed=5))
    return [r[name] for r in g.run()["rs"].collect()], g


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 100, 1000, 999_983])
def test_permutations_of_any_size(spark, size):
    n = min(size, 5000)
    got = [r.p for r in spark.range(n).select(G.permutation(F.col("id"), size, 3, "x").alias("p")).collect()]
    assert len(set(got)) == n and all(0 <= p < size for p in got)
    if size > 50:
        assert got != sorted(got) and sum(abs(a - b) for a, b in zip(got, got[1:], strict=False)) / n > size / 5
        assert got != [r.p for r in spark.range(n).select(G.permutation(F.col("id"), size, 4, "x").alias("p")).collect()]


@pytest.mark.parametrize(
    ("field", "rows", "fits"),
    [
        ("unique decimal(2) in 1..20", 1901, lambda v: 1 <= v <= 20 and round(v, 2) == v),
        ("unique decimal in 0..1", 3000, lambda v: 0 <= v <= 1),
        ("unique date in 2020..2023", 1461, lambda v: 2020 <= v.year <= 2023),
        ('unique regex("[A-F]{2}-\\\\d{2}x")', 3600, lambda v: re.fullmatch(r"[A-F]{2}-\d{2}x", v)),
        ("unique licensePlate()", 2000, lambda v: re.fullmatch(r"[A-Z]{3}-[0-9]{4}", v)),
        ("unique alphanumeric(30)", 500, lambda v: re.fullmatch(r"[A-Za-z0-9]{30}", v)),
        ("unique email()", 2000, lambda v: v.count("@") == 1),
        ("unique string", 2000, lambda v: v),
        ("unique boolean", 2, lambda v: v in (True, False)),
    ],
)
def test_whole_domains_without_a_repeat(spark, field, rows, fits):
    """Where the domain has just as many values as there are rows, each comes once."""
    got, g = rows_of(spark, field, rows)
    assert len(got) == len(set(got)) == rows and all(map(fits, got)) and not g.warnings


def test_named_texts_stay_named(spark):
    got, _ = rows_of(spark, "unique string", 300, "company_name")
    assert len(set(got)) == 300 and all("-" in v for v in got)


@pytest.mark.parametrize(("field", "rows"), [("unique decimal(0) in 1..5", 9), ("unique date in 2021..2021", 400), ('unique regex("[ab]c")', 3), ("unique boolean", 3)])
def test_domains_that_run_out_are_warned_of(spark, field, rows):
    got, g = rows_of(spark, field, rows)
    assert len(got) == rows and [w.kind for w in g.warnings] == [G.UNIQUE]


def test_slots():
    assert slots("a[bc]{2}(d)$") == ["a", "bc", "bc", "d"] and slots("ab|c") is None and slots("a{1,2}") is None and slots("") == [] and slots("[aab]") == ["ab"]
