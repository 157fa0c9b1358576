import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomwork.llm import pieces

TEXTS = ["", " ", "   x", "a  b", "tab\there", "new\nline\n\nx", "日本語のテキスト", "\U0001f642 emoji", "\r\n", "<s> </s>", "a" * 3000, "ﬁ éé", "<0x41>", "x\0y", "Hello, World! don't"]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(open(pieces.MODEL_PATH, "rb").read())


def test_ids_are_the_librarys(model):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("abcdeilnorst  \n.,éü12") for _ in range(r.randint(1, 60))) for _ in range(500)]
    ids, ends = model.encode_batch(texts)
    for i, t in enumerate(texts):
        got = ids[ends[i] : ends[i + 1]].tolist()
        assert got == library.encode(t), t
        assert model.decode(got) == library.decode(got) == t


def test_unigram_viterbi_against_all_segmentations(model):
    one = pieces.Pieces.__new__(pieces.Pieces)
    one.__dict__ |= model.__dict__
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab"]
    one.ids, one.scores, one.model_type, one.unknown_score = {n: i for i, n in enumerate(names)}, [-3.0, -2.5, -4.0, -4.4, -5.0, -8.0, -6.0, -7.5], pieces.UNIGRAM, -50.0
    one.names, one.fits, one.tails = names, {}, {"ab": (2, 1), "bc": (2, 1), "abc": (3, 2, 1), "ca": (2, 1), "cab": (3, 2, 1)}

    def best(word):
        if not word:
            return 0.0, []
        found = [(one.scores[one.ids[word[:n]]] + (rest := best(word[n:]))[0], [one.ids[word[:n]], *rest[1]]) for n in range(1, len(word) + 1) if word[:n] in one.ids]
        return max(found)

    words = sorted({"".join(random.Random(k).choices("abc", k=k % 7 + 1)) for k in range(80)})
    for word, ids in zip(words, one.segment(words), strict=True):
        assert abs(sum(one.scores[i] for i in ids) - best(word)[0]) < 1e-9 and "".join(names[i] for i in ids) == word


def test_tables(spark, odd_docs, no_docs, model):
    rows = pieces.decode(pieces.encode(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(r.decoded == r.text for r in rows)
    assert all(r.ids is None and r.n_tokens == 0 for r in rows if r.text is None) and all(r.n_tokens == len(r.ids) for r in rows if r.text is not None)
    assert pieces.decode(pieces.encode(no_docs)).count() == 0
    assert sorted(map(str, pieces.encode(odd_docs, decoded=True).collect())) == sorted(map(str, rows))


def test_clashing_columns(spark, odd_docs):
    df = odd_docs.withColumn("IDS", F.lit("old")).withColumn("n_tokens", F.lit("old")).withColumn("Decoded", F.lit(1)).withColumn("word", F.lit(2))
    out = pieces.encode(df, decoded=True)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and "word" in out.columns
    assert all(r.decoded == r.text and (r.text is None or r.n_tokens == len(r.ids)) for r in out.collect())
