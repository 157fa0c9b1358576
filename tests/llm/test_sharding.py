import struct
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import sharding


def plain(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain(int(k), n) for k in keys]
    a, b = sharding.jump_hash(keys, 8), sharding.jump_hash(keys, 9)
    assert ((a == b) | (b == 8)).all() and 0.05 < (b == 8).mean() < 0.18


def test_query(spark, odd_docs, saved, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 3)
    many = odd_docs
    for _ in range(3):
        many = many.union(odd_docs)
    rows = sharding.query(spark, saved(many, "documents")).collect()
    assert len(rows) == many.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.grown_shard in (r.shard, 8) and r.law == "key"
        key = 42 if r.doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        assert (r.shard, r.grown_shard) == (plain(key, 8), plain(key, 9))


def test_empty(spark, no_docs, saved):
    assert sharding.query(spark, saved(no_docs, "documents")).count() == 0


def test_clashing_columns(spark, odd_docs):
    df = odd_docs.withColumn("Shard", F.lit("old")).withColumn("SLOT", F.lit(None).cast("string")).withColumn("part", F.lit(1))
    out = sharding.number_rows(sharding.assign_shards(df, "doc_id", 3), "shard")
    assert len({c.lower() for c in out.columns}) == len(out.columns) and {"part", "text"} <= set(out.columns)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(r.shard in (0, 1, 2) for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_rows_of_one_partition_are_spread(spark):
    from loomwork.llm.common import spread

    one = spark.range(1000).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 1000
    even = spark.range(0, 1000, 1, 4)
    assert spread(even).rdd.getNumPartitions() == 4 and spread(even.limit(0)).count() == 0
