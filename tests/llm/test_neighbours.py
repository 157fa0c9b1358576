import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import neighbours


def exact(rows, asks, k):
    """By row number: the k nearest rows of each row that asks, of the same length, with null ids last among ties."""
    out = {}
    for i, (q, v) in enumerate(rows):
        if q is not None and asks(q):
            near = [(float(np.sqrt(((v - w) ** 2).sum())), j is None, j or 0, j) for m, (j, w) in enumerate(rows) if m != i and len(w) == len(v)]
            out[i] = (q, [(d, j) for d, _, _, j in sorted(near, key=lambda x: x[:3])[:k]])
    return out


def answers(rows, asks, k):
    return sorted(((q, n, j, d) for q, near in exact(rows, asks, k).values() for n, (d, j) in enumerate(near, 1)), key=str)


def test_recall_and_order(spark):
    got = neighbours.query(spark, "/root/testdata/sf0.01").collect()
    rows = [(r.vec_id, np.array(r.embedding, np.float32).astype(float)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = {(q, j) for q, _, j, _ in answers(rows, lambda i: i % 100 == 0, 10)}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want) and len(got) == len(want)
    vectors = dict(rows)
    for r in got:
        assert abs(r.score - np.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum())) < 1e-12


def test_odd_vectors_copies_and_ties(spark):
    """Repeated and null ids are rows of their own; other lengths are compared among themselves."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0]), (5, None), (6, [0.0, 0.0]), (7, [math.nan, 1.0]), (8, [None, 1.0]), (9, [math.inf, 1.0]), (10, [1.0]), (None, [1.0, 1.0]), (3, [0.0, 1.0]), (12, [2.0]), (None, [1.0, 0.0]), (15, [1.0, 2.0, 3.0]), (18, [])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("row", F.lit(1)).withColumn("n", F.lit("x"))
        got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df, lambda i: i % 3 == 0, 3).collect()), key=str)
        usable = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
        assert got == answers(usable, lambda i: i % 3 == 0, 3) and len(got) == 3 + 3 + 3 + 1
    assert neighbours.search(df.limit(0), lambda i: i % 3 == 0).count() == 0
    assert neighbours.search(df.where("vec_id = 0"), lambda i: i % 3 == 0).count() == 0


def test_doubles_keep_their_precision(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0 + 3e-9, 2.0, 3.0]), (2, [1.0, 2.0 + 1e-9, 3.0]), (3, [1.0, 2.0, 4.0]), (4, [1e200, 0.0, 0.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0, 3).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(j, d) for d, j in exact([(i, np.array(v)) for i, v in rows], lambda i: i == 0, 3)[0][1]]
    assert 0 < got[0].score < 4e-9


def test_index_reaches_its_recall_for_mixed_lengths_and_norms(spark):
    rng = np.random.default_rng(8)
    near = np.concatenate([rng.standard_normal((30, 16)) * s + rng.standard_normal(16) * 3 for s in np.geomspace(0.01, 30, 60)])
    other = rng.standard_normal((500, 5))
    vectors = [*near, *other]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, 10).collect()
    want = answers([(i, np.array(v)) for i, v in rows], lambda i: i % 20 == 0, 10)
    hits = {(q, j) for q, _, j, _ in want} & {(r.query_id, r.vec_id) for r in got}
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)


def test_large_buckets_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 8)).astype(np.float32)
    base[100:220] = base[100]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 50 == 0, 5).collect()
    want = answers([(i, np.array(v)) for i, v in rows], lambda i: i % 50 == 0, 5)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 150] == [100, 101, 102, 103, 104]
    assert len(got) == len(want) and len({(q, j) for q, _, j, _ in want} & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)


@pytest.mark.parametrize("held", [neighbours.HELD, 40])
def test_a_task_merges_what_its_chunks_give(spark, monkeypatch, held):
    """Of all chunks that a query meets in a task no more than the k nearest leave it; nothing is lost where it holds little."""
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    monkeypatch.setattr(neighbours, "HELD", held)
    sizes = []
    ranked = neighbours._ranked
    monkeypatch.setattr(neighbours, "_ranked", lambda found, *a: sizes.append(found.groupBy("query").count().agg(F.max("count")).first()[0]) or ranked(found, *a))
    vectors = np.random.default_rng(5).standard_normal((600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, 5).collect()
    want = answers([(i, np.array(v)) for i, v in rows], lambda i: i % 50 == 0, 5)
    assert len(got) == len(want) and len({(q, j) for q, _, j, _ in want} & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sizes and (held < neighbours.CHUNK * 6 or max(sizes) <= tasks * 6)


def test_best_of_several_chunks():
    two = [tuple(map(np.array, ([7, 7, 3], [1, 2, 9], [5, 6, 7], [0.5, 0.25, 1.0]))), tuple(map(np.array, ([7, 7, 3], [1, 4, 8], [5, 1, 2], [0.5, 0.25, 1.0])))]
    assert [c.tolist() for c in neighbours._best(two, 2)] == [[3, 3, 7, 7], [8, 9, 4, 2], [2, 7, 1, 6], [1.0, 1.0, 0.25, 0.25]]


def spread_of(vectors):
    """For each query, the share of all vectors that lie in one of the buckets it visits, by plain sets."""
    index = neighbours.fit(vectors[: neighbours.SAMPLE], len(vectors), 10)
    own = [neighbours.bucket_of(c) for c in index.cells(vectors)[0]]
    shares = []
    for tables in index.visits(vectors[::2000]):
        met = set()
        for t, buckets in enumerate(tables):
            met |= set(np.nonzero(np.isin(own[t], buckets))[0].tolist())
        shares.append(len(met) / len(vectors))
    return index, float(np.mean(shares))


@pytest.mark.parametrize(("kind", "most"), [("clustered", 0.05), ("uniform", 0.85)])
def test_recall_and_share_of_20000_vectors_at_shipped_constants(spark, kind, most):
    """Clusters are pruned to a few hundredths; on vectors without any structure no cells can prune much."""
    rng = np.random.default_rng(4)
    if kind == "clustered":
        vectors = np.repeat(rng.standard_normal((200, 32)), 100, axis=0) + 0.1 * rng.standard_normal((20_000, 32))
    else:
        vectors = rng.standard_normal((20_000, 32))
    vectors = rng.permutation(vectors)
    index, share = spread_of(vectors)
    assert index.probes >= 1 and share < most and abs(share - index.share) < 0.15, (share, index.share)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    got = {(r.query_id, r.vec_id) for r in neighbours.search(df, lambda i: i % 400 == 0).collect()}
    hits = 0
    for q in range(0, 20_000, 400):
        near = np.lexsort((np.arange(20_000), ((vectors - vectors[q]) ** 2).sum(1)))
        hits += len({(q, int(j)) for j in near[near != q][:10]} & got)
    assert len(got) == 500 and hits >= 0.9 * 500, hits


def test_the_index_is_used_on_small_tables(spark, monkeypatch):
    """Nothing switches it off: its probes are asked for at every size."""
    made = []
    whole = neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda *a: made.append(whole(*a)) or made[-1])
    assert neighbours.query(spark, "/root/testdata/sf0.001").count() > 0
    assert len(made) == 1 and made[0].recall >= 0.95 and made[0].share < 0.95 and made[0].probes > 1


def test_probe_sets_and_moves():
    sets = neighbours.probe_sets(4, 81)
    assert len({tuple(r) for r in sets.tolist()}) == len(sets) == 81 and not sets[0].any()
    assert all(not (r * r[::-1]).any() for r in sets)  # no line is crossed at both ends
    place = np.array([[0.1, 0.7, 0.4]])
    order = sorted([(x, k, -1) for k, x in enumerate(place[0])] + [(1 - x, k, 1) for k, x in enumerate(place[0])])
    for r, move in zip(neighbours.probe_sets(3, 27), neighbours.moves(place, 27)[0].tolist(), strict=True):
        want = [0, 0, 0]
        for j in np.nonzero(r)[0]:
            want[order[j][1]] += order[j][2]
        assert move == want
