import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomwork.llm import periodic


def suffixes(w, reverse):
    """Next smaller suffixes by comparing whole suffixes."""
    n = len(w)
    keys = [[-x if reverse else x for x in w[i:]] for i in range(n)]
    after = [next((j for j in range(i + 1, n) if keys[j] < keys[i]), n) for i in range(n)]
    shared = []
    for i, j in enumerate(after):
        size = 0
        while j + size < n and w[i + size] == w[j + size]:
            size += 1
        shared.append(size)
    return after, shared


def plain_runs(w, least, periods):
    """Every maximal stretch of each period whose smallest period it is."""
    out, n = [], len(w)
    for p in range(1, n // periods + 1):
        k = 0
        while k + p < n:
            start = k
            while k + p < n and w[k] == w[k + p]:
                k += 1
            length = k + p - start
            if k > start and length >= max(least, periods * p) and not any(all(w[x] == w[x + q] for x in range(start, start + length - q)) for q in range(1, p)):
                out.append((start, length, p))
            k = max(k, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(count, longest=50):
    rng = random.Random(5)
    for _ in range(count):
        n, k = rng.randrange(longest), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a, p = rng.randrange(n), 1 + rng.randrange(n // 2)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w


def test_next_smaller_suffixes():
    for w in sequences(1500):
        for reverse in (False, True):
            assert periodic.next_smaller(w, reverse) == suffixes(w, reverse), w


@pytest.mark.parametrize(("least", "periods"), [(6, 4), (1, 2), (2, 3)])
def test_runs_equal_all_stretches(least, periods):
    for w in sequences(1500):
        assert periodic.find_runs(w, least, periods) == plain_runs(w, least, periods), w


class Counted:
    """A word that counts how often it is compared."""

    seen = 0

    def __init__(self, x):
        self.x = x

    def __eq__(self, other):
        Counted.seen += 1
        return self.x == other.x

    def __lt__(self, other):
        Counted.seen += 1
        return self.x < other.x

    def __gt__(self, other):
        Counted.seen += 1
        return self.x > other.x


def fibonacci(n):
    a, b = [1], [1, 0]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("make", [fibonacci, lambda n: [1] * n, lambda n: [i % 2 for i in range(n)], lambda n: ([0] * 9 + [1]) * (n // 10), lambda n: [bin(i).count("1") % 2 for i in range(n)]])
def test_comparisons_are_linear(make):
    """No hard sequence takes more comparisons a word when it is ten times as long."""
    each = []
    for n in (3000, 30_000):
        Counted.seen = 0
        w = [Counted(x) for x in make(n)]
        periodic.find_runs(w, 1, 2)
        each.append(Counted.seen / n)
    assert each[1] < 20 and each[1] < 1.15 * each[0]


def stated(doc_id, text):
    """The stated results, by plain loops."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 6, 4)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{size},{p}\n" for s, size, p in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


def test_query_equals_plain_loops(spark, saved, odd_docs):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        n = rng.choice([0, 1, 5, 7, 40, 90])
        words = [rng.choice(["a", "b", "ä c", "d\x1c"]) for _ in range(n)]
        cut = rng.randrange(1, 4)
        rows.append((i, rng.choice([" ", "\n", "\t \v"]).join(words[:cut] * 7 + words[cut:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", F.substring("text", 1, 900).alias("text")))
    got = periodic.query(spark, saved(docs, "documents")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(stated(r.doc_id, r.text)) for r in docs.collect())
    assert sum(r.n_runs > 0 for r in got) > 50 and any(r.n_runs > 1 for r in got)


def test_looped_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in periodic.query(spark, "/root/testdata/sf0.001").collect()}
    assert all(got[r.doc_id] == stated(r.doc_id, r.text) for r in docs if len(r.text or "") < 3000) and len(got) == len(docs)


def test_long_odd_empty_and_clashing(spark, odd_docs, no_docs, saved):
    df = odd_docs.withColumn("RUNS", F.lit("old")).withColumn("collapsed", F.lit(1)).withColumn("words", F.lit("kept"))
    out = periodic.collapse_runs(df)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and got[6].collapsed == "word" and tuple(got[6].runs[0]) == (0, 30_000, 1) and got[6].words == "kept"
    assert got[2].runs == [] and got[2].collapsed == "" and got[4].collapsed == "" and got[1].collapsed == "hello world again and again"
    assert periodic.query(spark, saved(no_docs, "documents")).count() == 0
