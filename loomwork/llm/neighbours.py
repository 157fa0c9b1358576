"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector by the cells that it falls into on some random lines (normal directions are stable
under the Euclidean norm). A query visits its own bucket of each table and then those reached by moving to neighbouring
cells. Which moves come first is decided once for all queries, by the squared distances to the cells' borders that are
expected when a query's borders are sorted by distance; a query then fits its own borders in. The candidates of all tables
are merged and ranked by exact distance, in double precision.

The index is fitted on a bounded sample of each length of vectors, whatever the size of the table: of several widths of cells
and numbers of lines, each with as many probes as find WANTED of the sample's own neighbours, the one that visits the least
share of the vectors is taken. The recall and the share that the sample shows are logged; every vector is indexed.

Equal vectors are indexed once; of each such class at most one vector more than is asked for can be among the answers,
so the class keeps its smallest ids. Buckets are dealt to tasks in chunks of about CHUNK vectors; a chunk is held in
memory while the queries that visit its bucket stream past it. What a query finds in the chunks of one task is merged there,
so a task gives each query no more than its k nearest, however many chunks it met.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part. Vectors are
compared with those of the same length; of a length with no more than the wanted number of other vectors all are answers,
so it needs no index. Every row is a candidate, whatever its id: rows that share an id are vectors
of their own (only the query's own row is left out), and a null id comes last among ties. A query for which the buckets
hold too few candidates is compared with every vector of its length. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, bounded_sample, table

LOG = logging.getLogger("loomwork.llm.neighbours")
TABLES, MOST_PROBES = 4, 128
#: Widths of cells (in deviations of a projection) and numbers of lines that are tried.
CELLS, LINES = (0.7, 1.2, 2.0, 3.0, 6.0, 20.0), (1, 2, 3, 4, 6, 8, 10, 12, 16)
#: Vectors of the sample that the index is fitted on, queries among them, and the recall asked for there.
SAMPLE, SAMPLE_QUERIES, WANTED = 2000, 100, 0.96
#: Vectors of one chunk, and the seed of the lines.
CHUNK, LINE_SEED = 1024, 13
#: Distances that a task holds before it keeps the nearest of each query alone, and a part of it: it hands on what is left if
#: that is more, so that its memory has a bound.
HELD = 1 << 20


@dataclass
class Index:
    lines: np.ndarray  # tables, lines, dimensions; divided by the cell width
    shifts: np.ndarray  # tables, lines
    probes: int
    recall: float = 1.0
    share: float = 1.0  # of the vectors that a query meets

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and positions in the cell, each (tables, n, lines)."""
        at = np.einsum("nd,tld->tnl", x, self.lines) + self.shifts[:, None, :]
        low = np.floor(at)
        return low.astype(np.int64), at - low

    def visits(self, x: np.ndarray) -> np.ndarray:
        """The buckets of each vector's probes in each table, most promising first: (n, tables, probes)."""
        cells, places = self.cells(x)
        seen = []
        for t in range(len(self.lines)):
            there = cells[t][:, None] + moves(places[t], self.probes)
            seen.append(bucket_of(there.reshape(-1, there.shape[2])).reshape(there.shape[:2]))
        return np.stack(seen, axis=1)


def bucket_of(cells: np.ndarray) -> np.ndarray:
    """One 64-bit number for each row of cell numbers; equal rows give equal ones."""
    h = np.zeros(len(cells), np.uint64)
    for k in range(cells.shape[1]):
        h ^= cells[:, k].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) + (h << np.uint64(6)) + (h >> np.uint64(2))
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h.view(np.int64)


@functools.cache
def probe_sets(lines: int, count: int) -> np.ndarray:
    """The first ``count`` sets of borders to cross, as rows of 0 and 1 over a query's 2 * ``lines`` borders from the nearest
    to the farthest, by the sum of the squared distances to be expected of them. A line's two borders stand at places that
    mirror each other, so a set that holds both is left out.

    A heap holds sets; from the least one grow the next two: its last member moved one on, and one more member added.
    """
    j, n = np.arange(1, 2 * lines + 1), lines
    far = 2 * n + 1 - j
    cost = np.where(j <= n, j * (j + 1), 4 * (n + 1) * (n + 2) - 4 * far * (n + 2) + far * (far + 1)) / (4.0 * (n + 1) * (n + 2))
    found: list[tuple] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < count:
        total, some = heapq.heappop(heap)
        if all(2 * n - 1 - k not in some for k in some):
            found.append(some)
        last = some[-1]
        if last + 1 < 2 * n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*some[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*some, last + 1)))
    out = np.zeros((len(found), 2 * n), np.int64)
    for k, some in enumerate(found):
        out[k, list(some)] = 1
    return out


def moves(places: np.ndarray, count: int) -> np.ndarray:
    """Moves by -1, 0 or 1 cell on each line, (n, probes, lines), from positions in the cells (n, lines)."""
    n, lines = places.shape
    order = np.argsort(np.concatenate([places, 1 - places], axis=1), axis=1, kind="stable")
    crossed = np.zeros((n, 2 * lines, lines), np.int64)
    np.put_along_axis(crossed, (order % lines)[:, :, None], np.where(order < lines, -1, 1)[:, :, None], axis=2)
    return np.einsum("pj,njl->npl", probe_sets(lines, count), crossed)


def _needed(index: Index, sample: np.ndarray, asking: int) -> np.ndarray:
    """After how many probes a table each of the first ``asking`` vectors meets each vector of the sample."""
    own = [bucket_of(c) for c in index.cells(sample)[0]]
    first = np.full((asking, len(sample)), MOST_PROBES + 1)
    for i, tables in enumerate(index.visits(sample[:asking])):
        for t, buckets in enumerate(tables):
            seen, probe = np.unique(buckets, return_index=True)
            at = np.minimum(np.searchsorted(seen, own[t]), len(seen) - 1)
            first[i] = np.minimum(first[i], np.where(seen[at] == own[t], probe[at] + 1, MOST_PROBES + 1))
    return first


def fit(sample: np.ndarray, total: int, k: int, seed: int = LINE_SEED) -> Index:
    """The lines, cells and probes under which the sample's queries meet the least share of it, of those that find WANTED of
    its neighbours. The widest cells hold nearly all, so there always are some. A sample of ``total`` vectors is thinner than
    they are, so fewer of its vectors are as near as the k nearest: one more than its part of k is asked for."""
    n, d = sample.shape
    k = min(k, 1 + -(-k * n // max(n, total)))
    rng = np.random.default_rng(seed)
    lines, shifts = rng.standard_normal((TABLES, LINES[-1], d)), rng.random((TABLES, LINES[-1]))
    spread = float(np.sqrt(np.sum(np.var(sample, axis=0)))) or 1.0  # of a projection onto a line
    asking = min(n, SAMPLE_QUERIES)
    queries = sample[:asking]
    far = np.maximum(0, (queries**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * queries @ sample.T)
    far[np.arange(asking), np.arange(asking)] = np.inf
    near = np.argsort(far, axis=1, kind="stable")[:, : max(1, min(k, n - 1))]
    best = Index(lines[:, :1] * 0.0, shifts[:, :1], 1)  # one bucket for all
    for cell in CELLS:
        for count in LINES:
            index = Index(lines[:, :count] / (cell * spread), shifts[:, :count], MOST_PROBES)
            first = _needed(index, sample, asking)
            found = np.sort(np.take_along_axis(first, near, axis=1), axis=None)
            index.probes = int(found[int(np.ceil(WANTED * len(found))) - 1])
            if index.probes > MOST_PROBES:
                break  # more lines need more probes
            index.recall, index.share = float((found <= index.probes).mean()), float((first <= index.probes).mean())
            # a probe costs something too: of shares that are nearly equal the one with fewer is taken
            if index.share + 1e-5 * TABLES * index.probes < best.share + 1e-5 * TABLES * best.probes:
                best = index
    LOG.info("vectors of %d components: %d tables of %d lines, %d probes, recall %.3f, share of candidates %.3f in the sample", d, TABLES, best.lines.shape[1], best.probes, best.recall, best.share)
    return best


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


CANDIDATE, QUERY = 0, 1


def _spread(rows: DataFrame, indexes: dict[int, Index], probing: bool) -> DataFrame:
    """A row for each bucket that each vector (class, n, vector, first) is in, or is to visit: n, table, bucket, kind and
    the vector's own columns. Vectors of a length without an index are all in one bucket."""
    kind = QUERY if probing else CANDIDATE
    step = 64 if probing else 2048

    def run(batches):
        for batch in batches:
            classes, lengths, vectors, firsts = batch.column(0), batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            for n in np.unique(lengths):
                where = np.nonzero(lengths == n)[0]
                for at in range(0, len(where), step):
                    part = where[at : at + step]
                    if n not in indexes:
                        rows, tables, buckets = np.arange(len(part)), np.full(len(part), -1), np.zeros(len(part), np.int64)
                    elif probing:
                        seen = indexes[n].visits(_matrix(vectors.take(pa.array(part))))
                        rows, tables, _ = (i.reshape(-1) for i in np.indices(seen.shape))
                        buckets = seen.reshape(-1)
                    else:
                        cells, _ = indexes[n].cells(_matrix(vectors.take(pa.array(part))))
                        rows = np.tile(np.arange(len(part)), len(cells))
                        tables = np.repeat(np.arange(len(cells)), len(part))
                        buckets = np.concatenate([bucket_of(c) for c in cells])
                    for s in range(0, len(rows), 20_000):
                        take = pa.array(part[rows[s : s + 20_000]])
                        columns = [np.full(len(take), n, np.int32), tables[s : s + 20_000].astype(np.int32), buckets[s : s + 20_000], np.full(len(take), kind, np.int32)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), classes.take(take), vectors.take(take), firsts.take(take)], names=["n", "table", "bucket", "kind", "class", "vector", "first"])

    kind_of = rows.schema["vector"].dataType.simpleString()
    return rows.select("class", "n", "vector", "first").mapInArrow(run, f"n int, table int, bucket bigint, kind int, class bigint, vector {kind_of}, first bigint")


def _nearest(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, first: np.ndarray, x: np.ndarray, k: int):
    """(query, class, first id, distance) of the k nearest of x for each of q, ties by first id; the product of matrices
    only screens."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        xx = (x**2).sum(1)
        for at in range(0, len(q), 256):
            some = q[at : at + 256]
            rough = (some**2).sum(1)[:, None] + xx[None] - 2 * some @ x.T
            slack = 1e-9 * ((some**2).sum(1) + xx.max())
            limit = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1] + slack
            for i in range(len(some)):
                keep = np.nonzero(~(rough[i] > limit[i]))[0]  # what isn't a number stays
                exact = np.sqrt(((x[keep] - some[i]) ** 2).sum(axis=1))
                best = np.lexsort((xid[keep], first[keep], exact))[:k]
                out.append((np.full(len(best), qid[at + i]), xid[keep][best], first[keep][best], exact[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k nearest different classes of each query, from (query, class, first, distance) of several chunks and tables."""
    query, near, first, distance = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((near, first, distance, query))
    query, near, first, distance = query[order], near[order], first[order], distance[order]
    # a class met in several tables stands there several times, side by side, as its distance is the same
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (near[1:] != near[:-1])
    query, near, first, distance = query[new], near[new], first[new], distance[new]
    starts = np.nonzero(np.concatenate([[True], query[1:] != query[:-1]]))[0]
    sizes = np.diff([*starts, len(query)])
    keep = np.arange(len(query)) - np.repeat(starts, sizes) < k
    return query[keep], near[keep], first[keep], distance[keep]


def _matched(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest classes within the chunks of each task, whose rows come sorted: a chunk's candidates are held, its
    queries streamed. Only a task that holds more than half of HELD after merging gives a query several times k."""

    def out(found):
        for at in range(0, len(found[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000]) for c in found], names=["query", "class", "first", "distance"])

    def run(batches):
        key, parts, held, seen, count = None, [], None, [], 0
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            keys = np.stack([get(c).astype(np.int64) for c in ("n", "table", "bucket", "chunk", "kind")], axis=1)
            ids, firsts, vectors = get("class"), get("first"), batch.column(batch.schema.get_field_index("vector"))
            cuts = np.nonzero(np.any(keys[1:] != keys[:-1], axis=1))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if a == b:
                    continue
                if key is None or (keys[a][:4] != key).any():
                    key, parts, held = keys[a][:4].copy(), [], None
                if keys[a][4] == CANDIDATE:
                    parts.append((ids[a:b].copy(), firsts[a:b].copy(), _matrix(vectors.slice(a, b - a))))
                    held = None
                elif parts:
                    held = held or [np.concatenate(c) for c in zip(*parts, strict=True)]
                    seen.append(tuple(_nearest(ids[a:b], _matrix(vectors.slice(a, b - a)), *held, k)))
                    count += len(seen[-1][0])
                    if count > HELD:
                        seen = [_best(seen, k)]
                        count = len(seen[0][0])
                        if count > HELD // 2:
                            yield from out(seen[0])
                            seen, count = [], 0
        if seen:
            yield from out(_best(seen, k))

    order = ["n", "table", "bucket", "chunk"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *order).sortWithinPartitions(*order, "kind").mapInArrow(run, "query bigint, class bigint, first bigint, distance double")


def _chunked(scratch: Scratch, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates with the chunk of their bucket that they are dealt to, and queries with every chunk of theirs."""
    at = ["n", "table", "bucket"]
    heavy = candidates.groupBy(*at).count().where(F.col("count") > CHUNK)
    heavy = scratch.put(heavy.select(*at, F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "large-buckets")
    chunks = F.coalesce("chunks", F.lit(1))
    candidates = candidates.join(heavy, at, "left").withColumn("chunk", F.pmod(F.hash("class"), chunks)).drop("chunks")
    queries = queries.join(heavy, at, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("chunks")
    return candidates.unionByName(queries)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``row`` (a number of its own), ``id``, ``n`` (the length) and ``vector`` of the rows that take part. Floats stay
    floats, other numbers become doubles; both are compared as doubles."""
    kind = vectors.schema[vector].dataType
    kept = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    v = F.col(vector).cast(kept)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.size(v).alias("n"), v.alias("vector"))


def search(vectors: DataFrame, asks, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (distance) of the ``k`` nearest found for each vector for
    whose id the condition ``asks`` (a function of a column) holds."""
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = scratch.put(usable(vectors, key, vector), "vectors")  # so that the rows' numbers stay
    # the smallest ids of each class of equal vectors; the first row names the class
    over = Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last(), "row")
    members = rows.withColumn("at", F.row_number().over(over)).where(F.col("at") <= k + 1)
    members = members.groupBy("vector", "n").agg(F.min("row").alias("class"), F.coalesce(F.min("id"), F.lit((1 << 63) - 1)).alias("first"), F.collect_list(F.struct("id", "row")).alias("members"))
    members = scratch.put(members, "classes")
    queries = rows.where(asks(F.col("id")))
    asked = scratch.put(queries.join(members.select("vector", "class"), "vector").select("class", "n", F.col("id").alias("query_id"), F.col("row").alias("query_row")), "asked")
    lengths = rows.groupBy("n").agg(F.count(F.lit(1)).alias("count"))
    indexes = {}
    for r in members.groupBy("n").count().where(F.col("count") > k + 1).orderBy("n").collect():
        sample = bounded_sample(members.where(F.col("n") == r["n"]).select("vector"), SAMPLE)
        indexes[r["n"]] = fit(np.array([x["vector"] for x in sample], np.float64), r["count"], k)
    asking = members.join(asked.select("class").distinct(), "class", "left_semi")
    both = _chunked(scratch, _spread(members, indexes, False), _spread(asking, indexes, True))
    found = scratch.put(_ranked(_matched(both, k + 1), members, asked, k), "found")

    # queries with fewer answers than there are vectors of their length see all of these
    got = found.groupBy("query_row").agg(F.count(F.lit(1)).alias("got"))
    short = asked.join(got, "query_row", "left").join(lengths, "n").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("count") - 1))
    short = scratch.put(short.select("class", "n", "query_id", "query_row"), "short-queries")
    if short.limit(1).count():
        every = members.join(short.select("n").distinct(), "n", "left_semi")
        asking = members.join(short.select("class").distinct(), "class", "left_semi")
        whole = _ranked(_matched(_chunked(scratch, _spread(every, {}, False), _spread(asking, {}, True)), k + 1), members, short, k)
        found = scratch.put(found.join(short.select("query_row"), "query_row", "left_anti").unionByName(whole), "completed")
    scratch.drop(*[n for n in scratch.paths if n not in ("found", "completed")])
    return found.select("query_id", "rank", "vec_id", "score")


def _ranked(matches: DataFrame, members: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """For each row that asks, its k nearest rows, from the nearest classes of its own class."""
    best = matches.groupBy("query", "class", "first").agg(F.min("distance").alias("score"))
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("score", "first", "class"))).where(F.col("at") <= k + 1)
    rows = best.join(members.select("class", "members"), "class").select("query", "score", F.explode("members").alias("to"))
    rows = rows.join(asked.select(F.col("class").alias("query"), "query_id", "query_row"), "query").where("to.row <> query_row")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", F.col("to.id").asc_nulls_last(), "to.row"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "query_row", "rank", F.col("to.id").alias("vec_id"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
