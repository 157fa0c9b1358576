"""Sharding by jump consistent hashing: a stable key and the number of shards decide the shard, no ring table is kept,
and one shard more takes rows only into itself (about 1/n of all).

Defined results: a null key hashes like any other value, so all null keys share a shard; repeated rows share it too;
an empty table gives an empty table. Columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import OWN, drop_clashing, table, utf8, written

#: Rows that one sort group of the numbering aims at.
GROUP_ROWS = 50_000
#: A run of repeated rows is numbered in pieces of so many.
PIECE = 100_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of uint64 keys: each key jumps ahead from shard to shard, as a generator seeded by it decides, until it
    would land beyond the last one. All keys jump together; on average ln(shards) rounds are needed."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead = ((shard[live] + 1) * (2.0**31 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        on = ahead < shards
        live = live[on]
        shard[live] = ahead[on]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard (int, from 0) of a key of any hashable type."""

    @F.pandas_udf("int")
    def jump(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(h.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str, shards: int, column: str = "shard") -> DataFrame:
    """``df`` with the shard of each row by its key; no shuffle. Write it with ``partitionBy(column)`` for shard files."""
    df = drop_clashing(df, [column])
    return df.withColumn(column, shard_of(F.col(key), shards))


def number_rows(df: DataFrame, shard: str, slot: str = "slot") -> DataFrame:
    """Rows of ``df`` with a gapless position from 0 in their shard.

    Equal rows are first counted together, so a row that repeats without end travels as one. Shards are cut by hash
    into groups of bounded size; the groups' counts, summed within the shard, give each group its first position.
    """
    names = drop_clashing(df, [slot]).columns
    # each step below groups by two of shard, group and row, so no task needs a whole shard
    group, count, first, before = (f"{OWN}{x}" for x in ("group", "count", "first", "before"))
    slim = df.groupBy(*names).agg(F.count(F.lit(1)).alias(count))
    slim = written(slim, "shard-rows")
    groups = max(1, slim.count() // (GROUP_ROWS * 8))
    slim = slim.withColumn(group, F.pmod(F.xxhash64(*names, F.lit(1)), F.lit(groups)).cast("int"))
    sums = slim.groupBy(shard, group).agg(F.sum(count).alias(before))
    over = Window.partitionBy(shard).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(shard, group, F.coalesce(F.sum(before).over(over), F.lit(0)).alias(before))
    rows = Window.partitionBy(shard, group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = slim.join(sums, [shard, group]).withColumn(first, F.coalesce(F.sum(count).over(rows), F.lit(0)) + F.col(before))
    piece = f"{OWN}piece"
    out = out.withColumn(piece, F.explode(F.expr(f"sequence(0L, ({count} - 1) div {PIECE})")))
    last = F.least(F.col(count), (F.col(piece) + 1) * PIECE) - 1
    out = out.withColumn(slot, F.explode(F.sequence(F.col(piece) * PIECE + F.col(first), last + F.col(first))))
    return out.select(*names, slot)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = assign_shards(assign_shards(docs, "doc_id", 8), "doc_id", 9, "grown_shard")
    raw = utf8(F.col("text"))
    digest = placed.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "grown_shard",
    )
    return number_rows(digest, "shard").select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
