"""Blocked Bloom filters in DataFrame functions: each key sets eight bits in one 256-bit block of four longs.

Blocks are packed, ROW_BLOCKS of them in the array of one row, so that what is sent along is little more than the bits. A
filter is broadcast only while its bound (``Filter.bytes``) stays under BROADCAST_BYTES; beyond that the callers join
without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, OWN

#: Keys that a block is made for: 256 bits for 16 keys are 16 bits each, which passes about 1 in 500 wrongly.
KEYS_A_BLOCK = 16
#: Blocks in one row, and the bytes of such a row in a hash relation.
ROW_BLOCKS, ROW_BYTES = 64, 64 * 32 + 64
ROW, WORDS = f"{OWN}row", f"{OWN}words"


class Filter:
    """A filter of the distinct non-null values of one column, of which there are ``count``."""

    def __init__(self, listed: DataFrame, column: str, count: int):
        self.blocks = max(1, -(-count // KEYS_A_BLOCK))
        self.bytes = -(-self.blocks // ROW_BLOCKS) * ROW_BYTES
        block, bits = self._spot(F.col(column))
        marked = listed.select(block.alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(bits)])
        marked = marked.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)])
        at = F.pmod("block", F.lit(ROW_BLOCKS)).cast("int")
        entry = F.struct(at.alias("at"), F.array(*[F.col(f"w{k}") for k in range(4)]).alias("words"))
        rows = marked.groupBy(self._row(F.col("block")).alias(ROW)).agg(F.map_from_entries(F.collect_list(entry)).alias("of"))
        none = F.array(*[F.lit(0).cast("long")] * 4)
        words = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ROW_BLOCKS - 1)), lambda i: F.coalesce(F.try_element_at("of", i), none)))
        self.frame = rows.select(ROW, words.alias(WORDS))

    @property
    def small(self) -> bool:
        return self.bytes <= BROADCAST_BYTES

    def _spot(self, key: Column) -> tuple[Column, list[Column]]:
        """The block of a key and its two bits in each of the block's longs, from two independent 64-bit hashes."""
        h = F.xxhash64(key, F.lit(5))
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(63).cast("int"))
        return F.pmod(F.xxhash64(key), F.lit(self.blocks)), [bit(2 * k).bitwiseOR(bit(2 * k + 1)) for k in range(4)]

    @staticmethod
    def _row(block: Column) -> Column:
        return F.call_function("shiftright", block, F.lit(ROW_BLOCKS.bit_length() - 1))

    def marked(self, rows: DataFrame, key: Column, flag: str) -> DataFrame:
        """``rows`` with a boolean ``flag``: true for every key of the filter and for few others, false for null."""
        block, bits = self._spot(key)
        at = F.pmod(block, F.lit(ROW_BLOCKS)).cast("int")
        rows = rows.withColumn(ROW, self._row(block)).join(F.broadcast(self.frame), ROW, "left")
        hit = key.isNotNull()
        for k, b in enumerate(bits):
            hit = hit & (F.col(WORDS)[at * 4 + k].bitwiseAND(b) == b)
        return rows.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(ROW, WORDS)


def _sent(listed: DataFrame, column: str) -> tuple[DataFrame, int, bool]:
    """The listed keys as one column, how many there are, and whether they can themselves be sent along."""
    listed = listed.select(F.col(column).alias(f"{OWN}id"))
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.col(f"{OWN}id").cast("string"))), F.lit(0)).alias("chars")).first()
    return listed, size["n"], 4 * size["chars"] + 64 * size["n"] <= BROADCAST_BYTES


def having(rows: DataFrame, key: Column, listed: DataFrame, column: str) -> DataFrame:
    """The ``rows`` whose key is among the distinct non-null values of a column of ``listed``. These are sent along if they
    are few; or else a filter of them, and a join shuffles only the rows that it passes; or else, all rows."""
    listed, count, few = _sent(listed, column)
    names, bloom = rows.columns, Filter(listed, f"{OWN}id", count)
    if few:
        listed = F.broadcast(listed)
    elif bloom.small:
        rows = bloom.marked(rows, key, f"{OWN}maybe").where(f"{OWN}maybe").drop(f"{OWN}maybe")
    # not a semi-join, which the optimizer would move below the filter's join
    return rows.join(listed, key == F.col(f"{OWN}id")).select(*names)


def lacking(rows: DataFrame, key: Column, listed: DataFrame, column: str) -> DataFrame:
    """The other rows, those with a null key among them; the rows that a filter doesn't pass stay where they are."""
    listed, count, few = _sent(listed, column)
    bloom, flag = Filter(listed, f"{OWN}id", count), f"{OWN}maybe"
    if few or not bloom.small:
        return rows.join(F.broadcast(listed) if few else listed, key == F.col(f"{OWN}id"), "left_anti")
    names, seen = rows.columns, bloom.marked(rows, key, flag)
    return seen.where(~F.col(flag)).select(*names).unionByName(seen.where(flag).join(listed, key == F.col(f"{OWN}id"), "left_anti").select(*names))


def flagged(rows: DataFrame, key: Column, listed: DataFrame, column: str, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: whether the key is listed; the rows that a filter doesn't pass stay where they are."""
    listed, count, few = _sent(listed, column)
    names, bloom, own = rows.columns, Filter(listed, f"{OWN}id", count), F.col(f"{OWN}id")
    if few or not bloom.small:
        return rows.join(F.broadcast(listed) if few else listed, key == own, "left").select(*names, own.isNotNull().alias(flag))
    seen = bloom.marked(rows, key, f"{OWN}maybe")
    maybe = seen.where(f"{OWN}maybe").select(*names).join(listed, key == own, "left").select(*names, own.isNotNull().alias(flag))
    return seen.where(~F.col(f"{OWN}maybe")).select(*names, F.lit(False).alias(flag)).unionByName(maybe)
