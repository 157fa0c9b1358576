import corpus_pipeline as pipeline
import sentencepiece
from pyspark.sql import functions as F

from loomwork.llm import pieces

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    before = docs
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, before, SMALL).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 3:
            assert after.columns == names
            assert after.select(*names).subtract(before.select(*names)).count() == 0
        if i == 0:
            assert after.count() >= 0.98 * docs.count()
        if i == 1:
            assert after.select("text").distinct().count() == after.count() < before.count()
        if i == 3:
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
            texts = {r.doc_id: r.text for r in before.collect()}
            rows = after.collect()
            assert len(rows) == before.count() and all(r.exact and r.ids == library.encode(texts[r.doc_id]) for r in rows)
        before = after


def test_odd_and_empty(spark, odd_docs, no_docs):
    """Repeated rows, nulls, unlike texts under one doc_id and columns with clashing names."""
    words = "the people of the town went on to the river and said that it was not what they had thought of before"
    more = [(1, f"{words} {i} {'x' * i}", "en", None, None) for i in range(2)] + [(None, f"{words} and then {'again ' * 30}{i}", None, "src1", 1) for i in range(2)]
    docs = odd_docs.where("doc_id IS NULL OR doc_id <> 6").unionByName(spark.createDataFrame(more, odd_docs.schema))
    docs = docs.withColumn("id", F.lit(1)).withColumn("KEY", F.lit("x")).withColumn("epoch", F.lit(None).cast("int")).withColumn("tokens", F.lit("t")).withColumn("ids", F.lit(0))
    before = docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        after = stage(spark, before, SMALL)
        rows = [tuple(r) for r in after.collect()]
        if k < 3:
            assert after.columns == docs.columns and {tuple(r) for r in rows} <= {tuple(r) for r in before.collect()}
        if k == 0:
            assert all(any(c.isalpha() for c in r[1]) for r in rows)
        if k == 1:
            texts = [r[1] for r in rows]
            assert len(set(texts)) == len(texts) and {t[:9] for t in texts} == {r.text[:9] for r in before.collect()}
        if k == 3:
            assert all(r.exact for r in after.collect())
        before = spark.createDataFrame(rows, after.schema)
    for _, stage in pipeline.STAGES:
        no_docs = stage(spark, no_docs, SMALL)
        assert no_docs.count() == 0


def test_texts_under_one_id_stay(spark, odd_docs):
    kept = pipeline.drop_near_copies(spark, odd_docs, SMALL).collect()
    texts = {" ".join((r.text or "").split()) for r in odd_docs.collect()}
    assert {" ".join((r.text or "").split()) for r in kept} == texts and len(kept) == len(texts)
