"""Periodic runs of words, found in linear time by Lyndon arrays (after Ellert and Fischer, 2021), and their removal.

A run is a stretch of words with a smallest period that no neighbouring word extends. Each run has a Lyndon root in one of two
orders of the words, the given one and its reverse, and where such a root starts it is the longest Lyndon word there: it
ends at the next smaller suffix. So it is enough to find the next smaller suffix of each position in both orders, with
the length that the two suffixes share, which is how far the root's period goes on to the right.

Words are compared with one another and with nothing else: the alphabet is any ordered one; there are no ranks, suffix
arrays or hashes. Suffixes are compared along a stack of previous smaller suffixes. A comparison whose match ends beyond all
earlier ones (the box) is remembered, and later comparisons inside it are copies of those at its left end, whose lengths
are known; along the stack a length follows from the two before it. So no word is matched twice by an extension, and
all comparisons together take linear time. To the left a root is extended by less than a period, and only roots whose run is
long enough are.

Defined results: a null text has no words and no runs. Equal texts give equal results. An empty table gives an empty
table. Columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, ddl, drop_clashing, small_batches, spread, table

#: A run is asked to have at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def next_smaller(w: Sequence, reverse: bool = False) -> tuple[list[int], list[int]]:
    """For each position the next one whose suffix is smaller (``len(w)`` if none is), and how many words the two suffixes
    share. A suffix that ends is smaller than one that goes on. ``reverse`` turns the order of the words round."""
    n = len(w)
    after, shared = [n] * n, [0] * n
    before, common = [-1] * n, [0] * n  # the previous smaller suffix, and what it shares
    left = right = reach = 0  # the box: suffixes left and right agree up to reach in the right one
    for i in range(1, n):
        x, j, known, last = w[i], i - 1, 0, -1
        while j >= 0:
            y = w[j]
            if y == x:
                if i < reach and j >= right:  # inside the box: as at its left end, as far as the box goes
                    a, b = j - right + left, i - right + left
                    size = shared[a] if after[a] == b else common[b]
                    open_end = i + size >= reach
                    if open_end:
                        size = reach - i
                elif last < 0:
                    size, open_end = 1, True
                else:  # the suffix above shares ``known`` words with this one and common[last] with the next below
                    size, open_end = min(known, common[last]), known == common[last]
                if open_end:
                    k = i + size
                    k_left = j + size
                    while k < n and w[k_left] == w[k]:
                        k += 1
                        k_left += 1
                    size = k - i
                    if k >= reach:
                        left, right, reach = j, i, k
                known = size
                smaller = i + size < n and (w[j + size] > w[i + size] if reverse else w[j + size] < w[i + size])
            else:
                known = 0
                smaller = y > x if reverse else y < x
            if smaller:
                before[i], common[i] = j, known
                break
            after[j], shared[j] = i, known
            last, j = j, before[j]
    return after, shared


def find_runs(w: Sequence, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """Start, length and period of every run of at least ``least`` words and ``periods`` (2 or more) periods, in order of
    start and period."""
    out = set()
    n = len(w)
    for reverse in (False, True):
        after, shared = next_smaller(w, reverse)
        for i, size in enumerate(shared):
            # a root of the run's first period has at least all but two periods to its right
            if size and after[i] < n:
                p = after[i] - i
                if size + 2 * p > periods * p and not (i >= p and after[i - p] == i and w[i - p] == w[i] and shared[i - p] >= p):
                    k = i
                    while k > 0 and w[k - 1] == w[k - 1 + p]:
                        k -= 1
                    length = after[i] + size - k
                    if length >= periods * p and length >= least:
                        out.add((k, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def dropped(runs: list[tuple[int, int, int]], n: int) -> list[bool]:
    """Whether each of n words lies in a run after that run's first period."""
    depth = [0] * (n + 1)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    out, at = [], 0
    for d in depth[:n]:
        at += d
        out.append(at > 0)
    return out


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length and period, by start and period) of the words of each whole text, cut
    at ASCII white space, and ``collapsed``: the words that no run repeats, joined by one space."""
    names = ["runs", "collapsed"]
    own = f"{OWN}text"
    docs = docs.withColumn(own, F.col(text))
    docs = small_batches(drop_clashing(docs, names))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(own))
            found, collapsed = [], []
            for t in texts:  # one text at a time becomes a list of words
                words = (t.as_py() or "").encode().split()
                runs = find_runs(words, least, periods)
                if runs:
                    words = [x for x, gone in zip(words, dropped(runs, len(words)), strict=True) if not gone]
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                collapsed.append(b" ".join(words).decode())
            made = [pa.array(found, kind), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, f"{ddl(docs)}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string").drop(own)


def strongest(runs: Column) -> Column:
    """The run of greatest length by period; of equal ones that with the smallest start, then period. Null for none.
    Fractions are compared by products of whole numbers."""

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def looped(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` in which every tenth text, by the CRC-32 of its key, repeats a stretch of its words from some place on."""
    h, words = F.crc32(F.col(key).cast("string").cast("binary")), F.col(f"{OWN}words")
    chosen = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    docs = docs.withColumn(f"{OWN}words", F.when(h % 10 == 0, chosen))  # a column of its own, so that a text is cut once
    n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
    a = g % n
    docs = docs.withColumn(f"{OWN}from", F.when(n > 0, a)).withColumn(f"{OWN}step", F.when(n > 0, 1 + F.floor((n - a) / (3 + g % 8)).cast("long")))
    start, step = F.col(f"{OWN}from"), F.col(f"{OWN}step")
    again = F.transform(words, lambda x, i: F.when(i < start, x).otherwise(F.get(words, (start + (i - start) % step).cast("int"))))
    return docs.withColumn(text, F.when(step.isNotNull(), F.array_join(again, " ")).otherwise(F.col(text))).drop(*[f"{OWN}{x}" for x in ("words", "from", "step")])


def query(spark, sf_dir: str) -> DataFrame:
    docs = looped(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))
    seen = collapse_runs(docs).drop("text").withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return seen.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
