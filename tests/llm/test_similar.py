import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import similar
from loomwork.llm.simhash import words_of


def groups_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in similar.similar_groups(df).collect()}


def sets_of(texts):
    return [similar.shingles_of(words_of(t), similar.SHINGLE) for t in texts]


def overlap(a, b):
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def brute(texts):
    """Component of each text by all pairs of texts."""
    sets, root = sets_of(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and overlap(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_shingles_are_those_of_the_words():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4, 5, 6, 60):
        words = [b"w%d" % x for x in rng.integers(0, 5, n)]
        plain = {tuple(words[i : i + 5]) for i in range(max(1, n - 4))} if n else set()
        assert len(similar.shingles_of(words, 5)) == len(plain)
    assert similar.shingles_of([b"a", b"b"], 5) != similar.shingles_of([b"b", b"a"], 5)


def test_sketches_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(2)
    for n in (1, 30, 700):
        a, b = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n // 3, np.uint64)
        x, y = np.unique(a), np.unique(np.concatenate([a[n // 4 :], b]))
        apart = int(np.bitwise_count((similar.sketch_of(x) ^ similar.sketch_of(y)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(x, y)) and similar.sketch_of(x).shape == (similar.SKETCH,)


def test_pairs_in_a_dense_family(spark):
    """Texts that share a passage but are no copies of each other, and planted pairs among them."""
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = fresh(170)
    texts = [" ".join([*passage, *fresh(30)]) for _ in range(1200)]
    texts += [" ".join([*t.split()[:-14], *fresh(14)]) for t in texts[:100]]
    sets = sets_of(texts)
    assert overlap(sets[0], sets[1]) < 0.8 <= min(overlap(sets[i], sets[1200 + i]) for i in range(100))
    got = groups_of(spark, texts)
    assert all(got[1200 + i] == got[i] == i for i in range(100)) and len(set(got.values())) == 1200


def test_repeated_lines_and_short_texts(spark):
    """What is repeated in a copy adds nothing to its set; eight words and nine share four of five shingles."""
    rng = np.random.default_rng(4)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    texts = [" ".join(fresh(200)) for _ in range(20)] + [" ".join(fresh(8)) for _ in range(40)]
    texts += [f"{t} {' '.join(fresh(12) * 10)}" for t in texts[:20]] + [f"{t} {fresh(1)[0]}" for t in texts[20:60]]
    sets = sets_of(texts)
    assert min(overlap(sets[i], sets[60 + i]) for i in range(60)) >= 0.8
    got = groups_of(spark, texts)
    assert all(got[60 + i] == got[i] == i for i in range(60))


def test_chains_of_edits_against_all_pairs(spark):
    """2,000 texts: families whose members are edits of edits, at all similarities, and texts of a few words."""
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    texts = []
    while len(texts) < 2000:
        words = fresh(int(rng.integers(1, 12)) if rng.random() < 0.2 else int(rng.integers(20, 260)))
        for _ in range(int(rng.integers(1, 25))):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(int(rng.integers(0, 5))):
                words[int(rng.integers(len(words)))] = fresh(1)[0]
            if rng.random() < 0.3:
                words += fresh(int(rng.integers(1, 30)))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    assert groups_of(spark, texts) == brute(texts)


def test_keys_that_clash_lose_no_text(spark):
    """Five unlike texts with ids 1, 1, 2, null and null all stay; of copies one stays, whatever its key."""
    rng = np.random.default_rng(6)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    a, b, c, d, e = (fresh(40) for _ in range(5))
    rows = [(1, a), (1, b), (2, c), (None, d), (None, e)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("mine")).withColumn("id", F.lit(7))
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in similar.one_of_each(make(rows)).collect()), key=str)
    assert kept(rows) == sorted(rows, key=str)
    more = [*rows, (1, a), (3, a), (2, b), (None, c), (None, d), (4, e), (5, None), (6, ""), (None, " \n")]
    assert kept(more) in [sorted([(1, a), (1, b), (2, c), (None, d), (4, e), (5, x)], key=str) for x in (None, "", " \n")]
    assert set(similar.one_of_each(make(more)).columns) == {"doc_id", "text", "key", "id"}
    assert similar.one_of_each(make(rows).limit(0)).count() == 0
