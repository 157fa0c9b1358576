import hashlib
import math
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwork.llm import mixing


def levelled(given, caps, weights):
    """By raising the common level until nothing is left or all are full."""
    out, open_, left = {k: Fraction(0) for k in caps}, {k for k in caps if weights[k] > 0}, Fraction(given)
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        step = min([left / total] + [(caps[k] - out[k]) / weights[k] for k in open_])
        for k in open_:
            out[k] += step * weights[k]
        left -= step * total
        open_ = {k for k in open_ if out[k] < caps[k]}
    return {k: math.floor(v) for k, v in out.items()}


def brute(rows, how):
    leaves = defaultdict(list)
    for r in rows:
        number = re.search(r"([0-9]{1,9})$", r.source or "")
        domain = ["web", "books", "code"][int(number[1]) % 3] if number else "other"
        leaves[domain, r.lang, r.source].append((r.doc_id, len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text or ""))))
    tokens = {k: sum(t for _, t in v) for k, v in leaves.items()}
    w = lambda table, k: table.get(k, table[None])
    leaf = lambda k: tokens[k] * how.max_epochs if w(how.sources, k[2]) > 0 else 0
    lang = lambda d, x: sum(map(leaf, [k for k in leaves if k[:2] == (d, x)])) if w(how.languages, x) > 0 else 0
    domains = {k[0] for k in leaves}
    top = levelled(sum(tokens.values()) * how.budget // 1000, {d: sum(lang(d, x) for x in {k[1] for k in leaves if k[0] == d}) if w(how.domains, d) > 0 else 0 for d in domains}, {d: w(how.domains, d) for d in domains})
    out = []
    for d in domains:
        langs = {k[1] for k in leaves if k[0] == d}
        mid = levelled(top[d], {x: lang(d, x) for x in langs}, {x: w(how.languages, x) for x in langs})
        for x in langs:
            own = [k for k in leaves if k[:2] == (d, x)]
            low = levelled(mid[x], {k: leaf(k) for k in own}, {k: w(how.sources, k[2]) for k in own})
            for k in own:
                epochs = low[k] // max(tokens[k], 1)
                rest = low[k] - epochs * max(tokens[k], 1)
                place = lambda i: int(hashlib.md5(f"{how.seed}:{epochs}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)  # noqa: E731,B023
                for i, t in leaves[k]:
                    before = sum(u for j, u in leaves[k] if place(j) < place(i))
                    out += [(i, e) for e in range(epochs + (before < rest))]
    return sorted(out, key=str)


def test_against_brute_force(spark, odd_docs, no_docs):
    for docs, how in ((spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), mixing.Mix()), (odd_docs, mixing.Mix(budget=3000)), (odd_docs, mixing.Mix(budget=500, max_epochs=1, languages={"en": 1, None: 0}))):
        got = sorted(((r.doc_id, r.epoch) for r in mixing.mix(docs, how).select("doc_id", "epoch").collect()), key=str)
        assert got == brute(docs.collect(), how)
    assert mixing.mix(no_docs).count() == 0


def test_shortages_go_to_siblings_first():
    assert levelled(90, {"a": 10, "b": 100}, {"a": 1, "b": 1}) == {"a": 10, "b": 80}


ZEROS = [
    mixing.Mix(budget=700, sources={"src1": 0, "src4": 0, None: 1}),
    mixing.Mix(budget=900, languages={"en": 0, None: 3}, max_epochs=3),
    mixing.Mix(budget=500, domains={"web": 2, "books": 0, None: 1}, languages={"de": 0, None: 1}, sources={"src0": 0, None: 1}),
    mixing.Mix(budget=500, sources={None: 0}),
]


@pytest.mark.parametrize("how", ZEROS)
def test_zero_weights(spark, how):
    """A shortage never stays with what has no weight: the budget is used up while any capacity is left."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    got = sorted(((r.doc_id, r.epoch) for r in mixing.mix(docs, how).select("doc_id", "epoch").collect()), key=str)
    assert got == brute(rows, how)
    with duckdb.connect() as db:
        db.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
        assert sorted(((i, e) for i, e in db.sql(f"SELECT doc_id, epoch FROM ({mixing.oracle_sql(how)})").fetchall()), key=str) == got
    weight = lambda table, k: table.get(k, table.get(None, 0))
    count = lambda r: len((r.text or "").split())
    domain = lambda r: ["web", "books", "code"][int(re.search(r"\d+$", r.source)[0]) % 3] if re.search(r"\d+$", r.source or "") else "other"
    able = sum(count(r) for r in rows if min(weight(how.sources, r.source), weight(how.languages, r.lang), weight(how.domains, domain(r))) > 0) * how.max_epochs
    tokens = {r.doc_id: count(r) for r in rows}
    taken, budget = sum(tokens[i] for i, _ in got), min(able, sum(tokens.values()) * how.budget // 1000)
    assert taken >= budget - 50 and (taken == 0) == (able == 0)


def test_columns_stay(spark, odd_docs):
    out = mixing.mix(odd_docs.withColumn("epoch", F.lit("old")).withColumn("leaf", F.lit(1)))
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "leaf", "domain", "tokens", "epoch"}


def test_buckets_do_not_change_the_cut(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, mixing.mix(docs).select("doc_id", "epoch").collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "epoch").collect())) == want
