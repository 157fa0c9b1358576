import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwork.llm import licences


def plain(files):
    """The method by plain loops over all templates, places and files."""
    words = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in files]
    df = {}
    for w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    rare = [sorted({x for x in t.words if x in df}, key=lambda x: (df[x], x))[: licences.RARE] for t in licences.TEMPLATES]
    for w in words:
        base = sorted((i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        labels, best = {label for _, label in base}, 0.0
        for t, r in zip(licences.TEMPLATES, rare, strict=True):
            spots = [(q, x) for q, x in enumerate(t.words) if x in r]
            for place in range(-len(t.words), len(w)):
                votes = sum(0 <= place + q < len(w) and w[place + q] == x for q, x in spots)
                if votes < max(1, min(licences.AGREE, len(spots))):
                    continue
                near = lambda k, at: " ".join(["", *w[max(at - licences.SLACK, 0) : max(at + len(licences.split_words(k)) + licences.SLACK, 0)], ""])
                if all(f" {' '.join(licences.split_words(k))} " in near(k, place + t.place(k)) for k in t.keys):
                    labels.add(t.label)
                    best = max(best, votes / len(spots))
        score = max(best, 0.5 if base else 0.0)
        places = [i for i, _ in base]
        out.append((len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return out


@pytest.fixture(scope="module")
def files():
    """Every notice whole, in small pieces, with a word put in, among other words, twice and with others in one file."""
    rng = random.Random(11)
    noise = ["der", "hund", "mit", "license", "the", "of", "software", "copy", "ähre", "42", "public"]
    rows = [None, "", " \n", "MIT  License", "mit-license; apache\nLICENSE general public", "General-Public\tLicense mit license", "mit lizenz license mit", "ééé MİT license"]
    for t in licences.TEMPLATES:
        words = t.text.split()
        k = rng.randrange(1, len(words))
        rows += [t.text, t.text.upper(), " ".join(words[k:]), " ".join([*words[:k], "(c)", "Somebody", *words[k:]])]
        rows.append(" ".join(rng.choices(noise, k=40)) + "\n" + t.text + "\n" + " ".join(rng.choices(noise, k=40)) + "\n" + rng.choice(licences.TEMPLATES).text)
    rows += [" ".join(rng.choices(noise, k=200)) for _ in range(20)] + ["license " * 500, licences.TEMPLATES[0].text + " " + licences.TEMPLATES[0].text]
    return rows


def test_query_equals_plain_loops_and_sql(spark, saved, files):
    at = saved(spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(files)], "doc_id long, text string").repartition(3), "documents")
    got = sorted(repr(tuple(r)[1:]) for r in licences.query(spark, at).collect())
    assert got == sorted(map(repr, plain(files)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    assert got == sorted(repr(r[1:]) for r in con.sql(licences.oracle_sql()).fetchall())
    whole = {t.label: r for t, r in zip(licences.TEMPLATES, plain([t.text for t in licences.TEMPLATES]), strict=True)}
    assert all(label in r[5].split(",") and r[6] == 1.0 for label, r in whole.items())


def test_other_templates(spark):
    mine = [licences.Template("mine", "all copies are mine for ever and a day", ("mine for ever",))]
    df = spark.createDataFrame([("so all copies are mine for ever and a night",), ("all copies are for ever",), ("nothing",)], "body string")
    index = licences.build(df, mine, {"for ever": "long"}, "body")
    rows = licences.scan(df, index, "body").orderBy("n_words").collect()
    assert [r.labels for r in rows] == [[], ["long"], ["long", "mine"]]
    assert rows[2].licences[0].place == 1 and rows[2].phrases[0].place == 5 and rows[1].phrases[0].place == 3
    with pytest.raises(ValueError, match="doesn't hold"):
        licences.Template("x", "a b c", ("b d",))
    nothing = licences.build(df, [], {}, "body")
    assert all(r.labels == [] and r.score == 0.0 for r in licences.scan(df, nothing, "body").collect())


def test_odd_empty_and_clashing(spark, odd_docs, no_docs, saved):
    assert licences.query(spark, saved(no_docs, "documents")).count() == 0
    df = odd_docs.withColumn("SCORE", F.lit("old")).withColumn("labels", F.lit(1)).withColumn("words", F.lit("kept"))
    out = licences.scan(df, licences.build(df))
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(r.words == "kept" and r.labels == [] and r.score == 0.0 for r in rows)
    assert {r.doc_id: r.n_words for r in rows} == {1: 5, 2: 0, None: 3, 3: 0, 4: 0, 5: 1, 6: 30_000, 7: 4}
