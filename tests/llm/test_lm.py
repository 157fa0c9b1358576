import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import bloom, lm

TEXTS = [("Hello there, hello!", True), ("Grüße 123 \U0001f600", False), ("the the the", True), ("Привет, мир", False), ("тhe", False)]


def grams(texts):
    return Counter(tuple(g) for t in texts for g in lm.grams_of(t).tolist())


def plain(counts, letters):
    """-log2 p of a gram, from counts of all four-grams."""

    def p(gram):
        if not gram:
            return 1 / letters
        own = sum(n for g, n in counts.items() if g[lm.ORDER - len(gram) :] == gram)
        context = sum(n for g, n in counts.items() if g[lm.ORDER - len(gram) : -1] == gram[:-1])
        return (own + lm.TRUST * p(gram[1:])) / (context + lm.TRUST)

    return lambda gram: -math.log2(p(gram))


def test_losses_against_plain_counts(spark):
    near, far = grams(t for t, good in TEXTS if good), grams(t for t, _ in TEXTS)
    letters = len({g[-1] for g in far})
    docs = spark.createDataFrame(TEXTS, "text string, good boolean")
    counts = lm.counted(lm.dealt(docs), good="good").groupBy(*lm.GRAM).agg(F.sum("near").alias("near"), F.sum("far").alias("far"))
    rows = lm.losses(counts).collect()
    assert {(r.a, r.b, r.c, r.d) for r in rows} == set(far)
    by_near, by_far = plain(near, letters), plain(far, letters)
    for r in rows:
        g = (r.a, r.b, r.c, r.d)
        assert abs(r.loss_near - by_near(g)) < 1e-9 and abs(r.loss_far - by_far(g)) < 1e-9


@pytest.mark.parametrize("size", [lm.GROUP_CHARS, 1])
def test_scores(spark, odd_docs, no_docs, monkeypatch, size):
    """Whatever the groups, down to one text each, the score is the mean difference of losses over the tokens."""
    monkeypatch.setattr(lm, "GROUP_CHARS", size)
    few = odd_docs.where("doc_id IS NULL OR doc_id <> 6").withColumn("Score", F.lit("old"))
    rows = lm.score(few, good=F.col("doc_id").eqNullSafe(F.lit(1))).collect()
    got = {r.doc_id: r for r in rows}
    texts = [(r.text, r.doc_id == 1) for r in few.collect() if r.text]
    assert len(rows) == few.count() and lm.dealt(few).select(lm.GROUP).distinct().count() == (len(texts) if size == 1 else 1)
    near, far = grams(t for t, good in texts if good), grams(t for t, _ in texts)
    letters = len({g[-1] for g in far})
    by_near, by_far = plain(near, letters), plain(far, letters)
    own = [tuple(g) for g in lm.grams_of(got[7].text).tolist()]
    assert got[7].n_tokens == len(own) == len(got[7].text) + 1
    assert abs(got[7].score - np.mean([by_near(g) - by_far(g) for g in own])) < 1e-5
    assert got[2].score is None and got[3].n_tokens == 0 and got[1].score < 0 < got[7].score
    assert all(r.score in (0.0, None) for r in lm.score(few, good=F.lit(False)).collect())
    assert lm.score(no_docs).count() == 0


def test_many_grams_of_many_groups(spark, monkeypatch):
    """Random characters of several scripts: more different grams than a small group holds, all of them found again."""
    monkeypatch.setattr(lm, "GROUP_CHARS", 2000)
    monkeypatch.setattr(lm, "TOKENS", 300)
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.choice([97, 98, 0x416, 0x4E2D, 0x1F600, *range(0x500, 0x530)], 500))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(texts)], "doc_id long, text string, good boolean").repartition(3)
    got = {r.doc_id: r for r in lm.score(docs, good=F.col("good")).collect()}
    counts = [grams(t for i, t in enumerate(texts) if i % 3 == 0), grams(texts)]
    tail = [[Counter() for _ in range(lm.ORDER + 1)] for _ in counts]
    heads = [[Counter() for _ in range(lm.ORDER + 1)] for _ in counts]
    for m, c in enumerate(counts):
        for g, n in c.items():
            for k in range(lm.ORDER + 1):
                tail[m][k][g[lm.ORDER - k :]] += n
                if k:
                    heads[m][k][g[lm.ORDER - k : -1]] += n
    letters = len(tail[1][1])

    def p(m, g):
        return 1 / letters if not g else (tail[m][len(g)][g] + lm.TRUST * p(m, g[1:])) / (heads[m][len(g)][g[:-1]] + lm.TRUST)

    for i in (0, 17, 59):
        own = [tuple(g) for g in lm.grams_of(texts[i]).tolist()]
        want = [-np.mean([math.log2(p(m, g)) for g in own]) for m in (0, 1)]
        assert abs(got[i].loss_target - want[0]) < 1e-5 and abs(got[i].loss_background - want[1]) < 1e-5
    assert len(counts[1]) > 20_000 and len(got) == 60


def test_the_model_stays_off_the_driver(spark, odd_docs):
    """Neither stacked Python workers nor one for each part of the model."""
    plan = lm.score(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 0 and plan.count("FlatMapCoGroupsInArrow") == 1


def test_counts_cover_all_texts(spark, odd_docs, monkeypatch):
    want = sum(len(r.text) + 1 for r in odd_docs.collect() if r.text)
    assert sum(r.far for r in lm.counted(lm.dealt(odd_docs)).collect()) == want
    monkeypatch.setattr(lm, "GROUP_CHARS", 50)
    monkeypatch.setattr(lm, "TOKENS", 20)
    assert sum(r.far for r in lm.counted(lm.dealt(odd_docs)).collect()) == want


def test_groups_close_before_they_have_too_many_characters():
    group = lm.Group(100_000)
    assert group.takes("".join(map(chr, range(0x4E00, 0x9000)))) and group.takes("abc") and not group.takes("".join(map(chr, range(0x10000, 0x1C000))))
    codes = lm.Alphabet(np.array([97, 98], np.uint32))
    assert [g.tolist() for g in codes.grams(codes.of_text("ab"))] == [list(c) for c in zip(*lm.grams_of("ab").tolist(), strict=True)]


@pytest.mark.parametrize("limit", [1 << 30, 100_000, 0])
def test_flags(spark, monkeypatch, limit):
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", limit)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([None, *range(3000), 7])], "k long, i long")
    got = bloom.flagged(rows, F.col("k"), spark.range(0, 6000, 3), "id", "flag").collect()
    assert len(got) == 3002 and all(r.flag == (r.k is not None and r.k % 3 == 0) for r in got)
