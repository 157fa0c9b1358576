import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import components, similar, simhash
from loomwork.llm.common import written


def plain(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_are_spark_hashes(spark, odd_docs):
    got = simhash.fingerprints(odd_docs).collect()
    assert all(r.fingerprint % 2**64 == plain(r.text) for r in got)
    assert spark.sql("select xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_against_all_pairs(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(150)]
    prints = list({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(6)} | {0, 1, 7})
    df = written(spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fingerprint long"), "test")
    want = {tuple(sorted((a, b))) for i, a in enumerate(prints) for b in prints[:i] if bin(a ^ b).count("1") <= 3}
    for n in (len(prints), 10**5, 10**7):  # plans for larger tables find the same links
        parts = simhash.plan_parts(np.array(prints, np.uint64), n)
        assert sum(p.threshold + 1 for p in parts) >= 4 and len({b for p in parts for b in p.bits}) == sum(len(p.bits) for p in parts)
        got = {tuple(sorted((x.a % 2**64, x.b % 2**64))) for x in simhash.links(df, parts).collect()}
        assert got == want


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(50)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups(pairs, {n for p in pairs for n in p})
    assert got == {n: g for n, g in want.items() if n != g}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, odd_docs, no_docs, saved):
    near = odd_docs.union(spark.createDataFrame([(50, None, None, None, None)], odd_docs.schema))
    rows = simhash.query(spark, saved(near, "documents")).collect()
    assert len(rows) == near.count()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert got[2] == ("0" * 16, 2) and got[3] == got[4] == got[50] == ("0" * 16, 2) and got[1][1] == 1
    assert simhash.near_duplicates(no_docs).count() == 0


def test_similar_groups(spark, odd_docs, no_docs):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, i = [], 0
    for _ in range(60):
        words = [word() for _ in range(r.randint(60, 200))]
        for _ in range(4):
            copy = list(words)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy)))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {k: set(simhash.hashes_of(t, 5).tolist()) for k, t in rows}
    pairs = [(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = groups(pairs, sets)
    got = {x.doc_id: x.component_id for x in similar.similar_groups(df).collect()}
    assert got == want
    assert similar.similar_groups(no_docs).count() == 0
    kept = [x.doc_id for x in similar.one_of_each(odd_docs).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 2, 5, 6, 7] and kept.count(1) == 1


def test_extra_columns(spark, odd_docs):
    assert set(simhash.fingerprints(odd_docs.withColumn("Fingerprint", F.lit("x"))).columns) == {*odd_docs.columns, "fingerprint"}
