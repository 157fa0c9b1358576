import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import mine as M


def plain(df):
    """Every candidate tested on all rows, one by one."""
    numbers, _ = M._columns(df)
    num = {n: F.col(n).cast("double") for n in numbers}
    tests = []
    for t in numbers:
        others = [n for n in numbers if n != t]
        for a, b in itertools.combinations(others, 2):
            tests += [("product", (t, a, b), M.product(num[t], num[a], num[b])), ("sum", (t, a, b), M.total(num[t], num[a], num[b]))]
        for a, b in itertools.permutations(others, 2):
            tests += [("ratio", (t, a, b), M.ratio(num[t], num[a], num[b])), ("difference", (t, a, b), M.difference(num[t], num[a], num[b]))]
        tests += [("sum3", (t, *x), M.total(num[t], *[num[n] for n in x])) for x in itertools.combinations(others, 3)]
    return {(k, c, round(s, 9)) for k, c, _, s in M._screened(df, tests)}


@pytest.mark.parametrize("small", [1, 10**9])
def test_no_candidate_that_holds_is_ruled_out(spark, monkeypatch, small):
    """Nulls, outliers on nearly a twentieth of the rows, zeros, infinities and repeated rows; on a part and on all rows."""
    monkeypatch.setattr(M, "SMALL", small)
    rng = random.Random(6)
    rows = []
    for i in range(1200):
        a, b, c = rng.randrange(1, 50), rng.choice([0, 2, 3, 5]), rng.random() * 9
        bad = rng.random() < 0.045
        rows.append((a, b, c, 7.5 if bad else float(a * b), None if i % 3 else a + b + c, a - c, float("inf") if i == 7 else c / a, 1))
    rows += [rows[0]] * 300
    df = spark.createDataFrame(rows, "a int, b int, c double, p double, s double, d double, r double, one int").repartition(4)
    kept = []
    screened = M._screened
    monkeypatch.setattr(M, "_screened", lambda d, candidates: kept.extend(screened(d, candidates)) or kept)
    M.derivations(df)
    got = {(k, c, round(s, 9)) for k, c, _, s in kept if k != "multiple"}
    monkeypatch.setattr(M, "_screened", screened)
    assert got == plain(df) and {x[0] for x in got} >= {"product", "sum3", "difference", "ratio"}


def test_twenty_columns_take_three_passes(spark, monkeypatch):
    base = spark.range(30_000).select(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 7.0).alias(f"x{k:02d}") for k in range(17)])
    df = base.withColumn("product_", F.col("x00") * F.col("x01")).withColumn("three", F.col("x02") + F.col("x03") + F.col("x04")).withColumn("scaled", F.col("x05") * 2.5)
    tested = []
    whole = M._tested
    monkeypatch.setattr(M, "_tested", lambda d, candidates: tested.append(len(candidates)) or whole(d, candidates))
    found = {(r.kind, r.target, r.text) for r in M.derivations(df)}
    assert ("product", "product_", "x00 * x01") in found and ("sum3", "three", "x02 + x03 + x04") in found
    assert ("multiple", "scaled", "x05 * 2.5") in found or ("multiple", "x05", "scaled * 0.4") in found
    assert len(tested) == 1 and tested[0] <= M.CHUNK


def test_factors_are_the_means_of_the_ratios_in_one_small_plan(spark, monkeypatch):
    """Nulls and zeros count nowhere; no aggregate holds a mean for each pair."""
    rows = [(2, 4.0, None, 1), (3, 0.0, 5.0, 0), (None, 8.0, 2.5, 0), (0, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d int")
    n, known, means = M._factors(df, df.columns)
    assert n == 4 and known.tolist() == [3, 4, 3, 4]
    want = df.agg(*[F.avg(F.try_divide(F.col(t).cast("double"), F.col(s).cast("double"))).alias(t + s) for t in df.columns for s in df.columns if t != s]).first().asDict()
    got = {t + s: means[i, j] for i, t in enumerate(df.columns) for j, s in enumerate(df.columns) if t != s}
    assert {k: v for k, v in want.items() if v is not None} == pytest.approx({k: v for k, v in got.items() if v == v})


def test_fails_equal_those_of_single_relations():
    """Of each kind, with missing values and more sources than one matrix holds."""
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 5, (7, 90)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    for g in M._candidates(7):
        g_fails = g.fails(x)
        for row, count in zip(g.columns.tolist(), g_fails.tolist(), strict=True):
            bad = 0
            for t, *parts in x[row].T.tolist():
                if any(v != v for v in (t, *parts)):
                    continue
                if g.kind == "ratio" and parts[1] == 0:
                    bad += 1
                    continue
                e = {"product": lambda p: p[0] * p[1], "ratio": lambda p: p[0] / p[1], "difference": lambda p: p[0] - p[1]}.get(g.kind, sum)(parts)
                bad += abs(t - e) > (M.RELATIVE * max(abs(t), 1) if g.kind in ("sum", "sum3") else max(M.ABSOLUTE, M.RELATIVE * abs(t)))
            assert count == bad, (g.kind, row)


def test_few_columns_and_rows(spark):
    assert M.derivations(spark.range(5).select("id")) == [] and M.derivations(spark.createDataFrame([], "a int, b int, c int")) == []
    assert M.derivations(spark.createDataFrame([(None, None, None)], "a int, b int, c int")) == []
