import zlib

import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import langid

SMALL = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").select("doc_id", "held_out", "lang_pred", "lang", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    net = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), F.lit(True))
    got = {r.doc_id: r for r in langid.identify(odd_docs.withColumn("score", F.lit("old")), net).collect()}
    for k in (2, 3, 4, 5):
        assert (got[k].lang_pred, got[k].score) == (langid.UNKNOWN, 0.0)
    assert got[1].lang_pred in net.labels and got[6].lang_pred in net.labels
    assert langid.identify(no_docs, net).count() == 0 and langid.fit(no_docs, F.lit(True)) is None
    assert langid.identify(odd_docs, None).where("lang_pred <> 'und'").count() == 0


def test_windows_cover_the_whole_text():
    raw = bytes(range(1, 251)) * 3
    w = langid.windows_of(raw)
    assert w.tobytes().rstrip(b"\0") == raw and w.shape[1] == langid.WINDOW and langid.windows_of(b"").shape[0] == 0


def test_network_matches_plain_loops():
    rng = np.random.default_rng(0)
    x, y, names = rng.integers(97, 122, (64, langid.WINDOW)).astype(np.uint8), rng.integers(0, 2, 64), ["a", "b"]
    net = langid.train(x, y, names, epochs=1)
    again = langid.train(x, y, names, epochs=1)
    assert np.array_equal(net.filters, again.filters)
    top = net.pooled(x[:1])[2][0]
    vectors = net.table[np.concatenate([x[0], np.zeros(3, np.uint8)])]
    for f in (0, 10, 25):
        width = int(np.repeat(langid.WIDTHS, langid.FILTERS)[f])
        plain = max(float((vectors[i : i + width].reshape(-1) * net.filters[: width * langid.EMBEDDING, f]).sum()) for i in range(langid.WINDOW))
        assert abs(plain - top[f]) < 1e-3


def test_labels_stay_where_all_ids_are_one(spark):
    """Ids say nothing: with one id on every row, or none, and with many copies, all languages are learned."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    labels = sorted({r.lang for r in docs.select("lang").distinct().collect() if r.lang})
    copies = docs.where("lang = 'en'").limit(1).crossJoin(spark.range(3000)).select("text", "lang")
    nets = []
    for key in (F.lit(7), F.lit(None).cast("long")):
        net = langid.fit(docs.select(key.alias("doc_id"), "text", "lang").unionByName(copies.withColumn("doc_id", key)), F.lit(True))
        assert net.labels == labels
        nets.append(net)
    assert np.array_equal(nets[0].filters, nets[1].filters)
    again = langid.fit(docs.select("text", "lang").unionByName(copies).repartition(7), F.lit(True))
    assert np.array_equal(nets[0].filters, again.filters)


def test_only_letters_count(spark):
    net = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), F.lit(True))
    texts = ["\u00b2\u00bd", "\u2167", "12_34", "\u2460 \u00b3", "x\u00b2", "\u4e2d", "\u02b0"]
    got = [p[0] for p in langid.predict(net, texts)]
    assert got[:4] == [langid.UNKNOWN] * 4 and langid.UNKNOWN not in got[4:]


def test_many_languages_are_all_learned(spark):
    rows = [(f"l{k:03d}", chr(0x4E00 + k) * 40 + str(i)) for k in range(300) for i in range(2)]
    net = langid.fit(spark.createDataFrame(rows, "lang string, text string"), F.lit(True))
    assert len(net.labels) == 300
