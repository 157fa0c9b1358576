"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's bit is set when more than half of a text's shingle hashes have it set. Two fingerprints that differ in
at most t bits must, for any division of the bits into parts with thresholds e_i where the sum of (e_i + 1) is t + 1,
differ in at most e_i bits of some part i. Bits that go together are put into the same part (so that the parts are as
unlike each other as can be), and dynamic programming gives the parts unequal thresholds so that the estimated work, rows sent
plus candidates compared, is least; -1 leaves a part out. Each fingerprint probes the parts with all changes of up to
e_i bits; what meets is verified on all 64 bits inside the join, so that only links come out of it.

Work is done on distinct fingerprints: copies never meet in pairs, however many there are.

Defined results: a null, empty or blank text has fingerprint zero, which is linked like any other. A text of fewer
words than a shingle is one shingle. Repeated rows share a component. An empty table gives an empty table. Columns named
like an output are replaced.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, Scratch, bounded_sample, ddl, drop_clashing, small_batches, spread, table
from .components import components

BITS, SHINGLE, MOST_BITS, SEED = 64, 3, 3, 42
#: Fingerprints that the parts are fitted on.
SAMPLE = 4000
#: A compared candidate costs this share of a row that is sent, sorted and joined.
PAIR_COST = 0.05


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between runs of space, tab, line feed, vertical tab, form feed and return, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(size)), strict=False)))


def hashes_of(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    digest = xxhash.xxh64_intdigest
    shingles = shingles_of(words_of(text), size)
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    rows = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(n, 8)
    for at in range(0, n, 255):  # so many fit a byte
        counts += np.add.reduce(np.unpackbits(rows[at : at + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the 64-bit ``fingerprint`` of each whole text as a (signed) long."""
    docs = small_batches(drop_clashing(docs, ["fingerprint"]))

    def run(batches):
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(text))
            made = np.fromiter((majority(hashes_of(source[i].as_py(), shingle)) for i in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view(np.int64))], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, f"{ddl(docs)}, fingerprint bigint")


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))

    @property
    def changes(self) -> list[int]:
        """All ways to change up to ``threshold`` of the part's bits."""
        return [_signed(sum(1 << b for b in some)) for k in range(self.threshold + 1) for some in itertools.combinations(self.bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grouped(bits: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """The bits in parts of (nearly) equal size, each grown from one bit by the bit that goes with it most."""
    spread = bits.std(axis=0) > 0
    close = np.zeros((BITS, BITS))
    if spread.sum() > 1:
        close[np.ix_(spread, spread)] = np.abs(np.corrcoef(bits[:, spread], rowvar=False))
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        one = [max(free, key=lambda b: (close[b, free].sum(), -b))]
        free.remove(one[0])
        while len(one) < size:
            b = max(free, key=lambda b: (close[b, one].sum(), -b))
            one.append(b)
            free.remove(b)
        out.append(tuple(sorted(one)))
    return out


def plan_parts(sample: np.ndarray, count: int, most: int = MOST_BITS) -> list[Part]:
    """Parts and thresholds of least estimated work for ``count`` distinct fingerprints, from a sample of them."""
    sample = np.unique(sample.astype(np.uint64))
    n = len(sample)
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    p = bits.mean(axis=0) if n else np.full(BITS, 0.5)
    alike = p * p + (1 - p) * (1 - p)
    best: tuple[float, list[Part]] | None = None
    few = sample[:: max(1, n // 1500)]
    for m in range(1, 2 * (most + 1)):
        groups = _grouped(bits if n > 1 else np.zeros((2, BITS)), m)
        costs = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            near = np.bincount(np.bitwise_count((few[:, None] ^ few[None, :]) & mask).ravel(), minlength=BITS + 1).astype(float)
            near[0] -= len(few)
            seen = np.cumsum(near) / max(1, len(few) * (len(few) - 1))
            model = np.zeros(most + 2)  # the same if bits were independent: chance of exactly k differences
            model[0] = 1
            for b in g:
                model = model * alike[b] + np.concatenate([[0], model[:-1]]) * (1 - alike[b])
            by = [0.0]
            for e in range(most + 1):
                probes = sum(1 for k in range(e + 1) for _ in itertools.combinations(range(len(g)), k)) if e < 3 else float("inf")
                rate = max(seen[e], model[: e + 1].sum())
                by.append(count * (1 + probes) + PAIR_COST * rate * count * count / 2)
            costs.append(by)
        # least cost with the sum of (threshold + 1) at least most + 1
        table = [(0.0, ())] + [(float("inf"), ())] * (most + 1)
        for by in costs:
            table = [min((table[max(0, need - k)][0] + by[k], (*table[max(0, need - k)][1], k - 1)) for k in range(len(by))) for need in range(most + 2)]
        cost, thresholds = table[most + 1]
        if best is None or cost < best[0]:
            best = (cost, [Part(g, e) for g, e in zip(groups, thresholds, strict=True) if e >= 0])
    return best[1]


def links(prints: DataFrame, parts: list[Part], most: int = MOST_BITS, column: str = "fingerprint") -> DataFrame:
    """Pairs (``a`` > ``b``) of distinct fingerprints that differ in at most ``most`` bits."""
    f = F.col(column)
    index = probes = None
    for i, part in enumerate(parts):
        own = f.bitwiseAND(F.lit(part.mask))
        kept = prints.select(F.lit(i).alias("part"), own.alias("value"), f.alias("a"))
        changed = F.explode(F.array(*[F.lit(c).cast("long") for c in part.changes]))
        asked = prints.select(f.alias("b"), own.alias("own"), changed.alias("change"))
        asked = asked.select(F.lit(i).alias("part"), F.col("own").bitwiseXOR(F.col("change")).alias("value"), "b")
        index = kept if index is None else index.unionByName(kept)
        probes = asked if probes is None else probes.unionByName(asked)
    verified = (F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    met = index.join(probes, (index["part"] == probes["part"]) & (index["value"] == probes["value"]) & verified)
    return met.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """``key``, ``fingerprint`` (long) and ``component_id``, the smallest key that links can reach, of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    slim = docs.select(F.col(key).alias(f"{OWN}key"), F.col(text).alias(f"{OWN}text"))
    slim = scratch.put(fingerprints(slim, f"{OWN}text", shingle).select(f"{OWN}key", "fingerprint"), "fingerprints")
    prints = scratch.put(slim.groupBy("fingerprint").agg(F.min(f"{OWN}key").alias("first")), "distinct")
    count = prints.count()
    sample = bounded_sample(prints.select("fingerprint"), SAMPLE)
    parts = plan_parts(np.array([r["fingerprint"] for r in sample], np.int64).view(np.uint64), count, most)
    stars = components(links(prints, parts, most), scratch=scratch)
    rooted = prints.join(stars, prints["fingerprint"] == stars["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.put(rooted.join(least, "root").select("fingerprint", "component_id"), "named")
    scratch.drop("distinct", "stars")
    return slim.join(named, "fingerprint").select(F.col(f"{OWN}key").alias(key), "fingerprint", "component_id")


def hex_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")
