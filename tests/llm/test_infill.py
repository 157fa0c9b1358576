import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwork.llm import infill

SMALL = "/root/testdata/sf0.001"


def plain(doc_id, text):
    """The stated rules, one character after another."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out, p, m = "plain", text, None, None
    elif h[3] % 100 < 80:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (out, text)]
    return (doc_id, n, form, None if p is None else len(p), None if m is None else len(m), *sha)


def odd_texts():
    rng = random.Random(3)
    alphabet = " \t\n\v\f\r\x1c\x85  ab<>PSMü\U0001f600\0"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(400)] + ["<P>", "<", "a <P", "S>", " " * 50, None, ""]


def test_query_equals_the_rules(spark, saved, odd_docs):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "null id"), (7, "again"), (7, "again"), (-3, "b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    got = infill.query(spark, saved(docs, "documents")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain(r.doc_id, r.text)) for r in docs.collect())
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_query_equals_sql(spark):
    got = infill.query(spark, SMALL)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(infill.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("grammar", [infill.WORDS, infill.LINES, infill.RUNS])
def test_units_equal_the_grammar(spark, grammar):
    texts = [t for t in odd_texts() if t]
    pattern = re.compile(grammar.pattern.replace(r"\x{10FFFF}", "\U0010ffff"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", infill.units(F.col("t"), grammar).alias("u")).collect()
    assert all(r.u == pattern.findall(r.t) for r in got)


def test_grammars_that_neighbours_do_not_decide_are_refused():
    with pytest.raises(ValueError, match="neighbours"):
        infill.Grammar({"a": "a", "b": "^a"}, "aa|a|b").borders()
    with pytest.raises(ValueError, match="cover"):
        infill.Grammar({"a": "a", "b": "^a"}, "a+").borders()
    assert infill.Grammar({"a": "a", "b": "^a"}, "[ab]+".replace("[ab]", "(?:a|b)")).boundary == "(?!)"


def test_empty_and_clashing(spark, no_docs, odd_docs, saved):
    assert infill.query(spark, saved(no_docs, "documents")).count() == 0
    df = odd_docs.withColumn("FORM", F.lit("old")).withColumn("output", F.lit(1)).withColumn("units", F.lit("kept"))
    out = infill.fill_in_middle(df, infill.LINES, rate=100)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == odd_docs.count() and all(r.back == (r.text or "") and r.units == "kept" for r in rows)
    assert all((r.form == "plain") == (not r.text) for r in rows)
