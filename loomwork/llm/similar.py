"""Near-copies by similarity: overlap (Jaccard) of sets of word shingles, for stages that ask for a similarity.

Fingerprints of 64 bits that differ in three bits show only the closest copies, so they come first and don't have the
last word. Groups are found in three steps, each of which compares only texts of different groups:

1. SimHash fingerprints of the sets, probed by the generalised pigeonhole (``simhash.links``): representatives of equal and
   of near fingerprints meet.
2. The same principle on the sets themselves. All shingles are put in one order, rare ones first. Sets of size n at the limit
   differ in so few shingles that they must agree on one of the first ``n - ceil(limit * n) + 1`` of each: those shingles
   are parts with threshold 0, all commoner ones parts with threshold -1. In a few rounds each text is compared with the
   closest of those that come before it on its shingles, in orders that differ from shingle to shingle.
3. All texts of different groups that agree on such a shingle, with enough left in both, are compared. So nothing is
   missed whatever the first steps did; they only make the groups so large that little is left to compare.

Every pair passes a bound before its sets are fetched: parity sketches (bit i tells whether an odd number of shingles fall
to place i) differ in no more places than the sets do. What passes is verified on the whole sets. The order (counts of
all shingles of all texts, folded to a table of fixed size) decides only how much work is done.

Copies of a text (equal words) share a 64-bit identity and are compared once. Shingles are 64-bit hashes. Defined results:
a null, empty or blank text is linked with others like it; a text of fewer words than a shingle is one shingle; repeated
rows are copies. Rows that share a key but not a text are judged by their texts. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bloom import having, lacking
from .common import OWN, Scratch, bounded_sample, ddl, small_batches
from .components import components
from .simhash import SAMPLE, links, majority, plan_parts, words_of

SHINGLE, SIMILAR = 5, 0.8
#: Slots of the table of shingle counts, and slots sent in one row.
SLOTS, SLOTS_A_ROW = 1 << 21, 1 << 16
#: Longs of a parity sketch, rounds of the second step, and words whose hashes a worker keeps.
SKETCH, ROUNDS, KEPT_WORDS = 16, 2, 1 << 16
#: Shingles that are counted at once.
GROUP = 1 << 20


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingles_of(words: list[bytes], size: int, known: _Words | None = None) -> np.ndarray:
    """The distinct shingles of a text, sorted: 64-bit hashes made of those of their words in order."""
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map((_Words() if known is None else known).__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ one[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out * np.uint64(0xD6E8FEB86659FD93))


def identity_of(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def sketch_of(own: np.ndarray) -> np.ndarray:
    """SKETCH longs: the parity of the shingles that fall to each bit."""
    bits = np.bincount((own >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def prefix_of(own: np.ndarray, counts: np.ndarray, similar: float) -> np.ndarray:
    """The first shingles of a set in the common order, so many that a set at the limit shares one."""
    order = np.lexsort((own, counts[own % np.uint64(SLOTS)]))
    return own[order[: len(own) - math.ceil(similar * len(own) - 1e-9) + 1]]


def counts_of(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How many texts (a column) hold a shingle of each slot, as steps of a quarter of a doubling (a byte each)."""

    def count(batches):
        known, sums, group, held = _Words(), np.zeros(SLOTS, np.int32), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                group.append(shingles_of(words_of(batch.column(0)[i].as_py()), shingle, known) % np.uint64(SLOTS))
                held += len(group[-1])
                if held > GROUP or i == batch.num_rows - 1:
                    sums += np.bincount(np.concatenate(group).astype(np.int64), minlength=SLOTS).astype(np.int32)
                    group, held = [], 0
        for k in np.nonzero(sums.reshape(-1, SLOTS_A_ROW).any(axis=1))[0]:
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([zlib.compress(sums[k * SLOTS_A_ROW : (k + 1) * SLOTS_A_ROW].tobytes(), 1)])], names=["part", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(n), np.int32).astype(np.int64)
        for k, n in sums.items():
            steps = np.minimum(255, np.round(4 * np.log2(1 + n))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([steps.tobytes()])], names=["part", "n"])

    sent = texts.mapInArrow(count, "part int, n binary").repartition("part")
    out = np.zeros(SLOTS, np.uint8)
    for r in sent.mapInArrow(add, "part int, n binary").collect():  # of a fixed size
        out[r["part"] * SLOTS_A_ROW : (r["part"] + 1) * SLOTS_A_ROW] = np.frombuffer(r["n"], np.uint8)
    return out


def features(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``key``, ``id`` (the text's identity), ``size``, ``print`` (SimHash) and ``sketch`` of each row (key, text)."""

    def run(batches):
        known = _Words()
        for batch in batches:
            ids, sizes, prints, sketches = [], [], [], []
            for i in range(batch.num_rows):
                words = words_of(batch.column(1)[i].as_py())
                own = shingles_of(words, shingle, known)
                ids.append(identity_of(words))
                sizes.append(len(own))
                prints.append(majority(own))
                sketches.append(sketch_of(own))
            flat = pa.array(np.concatenate(sketches)) if sketches else pa.array([], pa.int64())
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * SKETCH)
            columns = [batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "size", "print", "sketch"])

    return rows.mapInArrow(run, f"{ddl(rows.select('key'))}, id bigint, size int, print bigint, sketch array<bigint>")


def _prefixes(rows: DataFrame, shingle: int, similar: float, counts) -> DataFrame:
    """``shingle``, ``id`` and ``place`` (the set's size, and how many shingles are left from this one on) of the prefixes."""

    def run(batches):
        known, seen = _Words(), set()  # a copy within a task sends nothing again
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, firsts, sizes = [], [], []
                for i in range(start, min(start + 256, batch.num_rows)):
                    words = words_of(batch.column(0)[i].as_py())
                    one = identity_of(words)
                    if not words or one in seen:
                        continue
                    seen.add(one)
                    own = shingles_of(words, shingle, known)
                    ids.append(one)
                    firsts.append(prefix_of(own, counts.value, similar))
                    sizes.append(len(own))
                if ids:
                    many = [len(x) for x in firsts]
                    left = np.repeat(np.array(sizes, np.int64), many)
                    place = (left << 32) + left - np.concatenate([np.arange(n) for n in many])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), many)), pa.array(place)], names=["shingle", "id", "place"])

    return rows.select("text").mapInArrow(run, "shingle bigint, id bigint, place bigint")


class _Texts:
    """The rows (key, text) of one call, and the tables made of them."""

    def __init__(self, rows: DataFrame, shingle: int, similar: float):
        self.rows, self.shingle, self.similar = rows, shingle, similar
        self.scratch = Scratch(rows.sparkSession, "similar")
        self.features = self.scratch.put(features(rows, shingle), "features")
        self.texts = self.scratch.put(self.features.groupBy("id").agg(F.min("key").alias("key"), F.count("key").alias("keys"), *[F.first(c).alias(c) for c in ("size", "print", "sketch")]), "texts")
        self.nameless = bool(self.texts.where("keys = 0").limit(1).count())

    def apart(self, size_a: Column, size_b: Column) -> Column:
        """How many shingles two sets at the limit may differ in."""
        return F.lit((1 - self.similar) / (1 + self.similar)) * (size_a + size_b) + 1e-6

    def enough(self, a: Column, b: Column) -> Column:
        """Whether two places leave enough shingles, counted from the first one that the sets share."""
        left = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.least(left(a), left(b)) >= F.lit(self.similar / (1 + self.similar)) * (_size(a) + _size(b)) - 1e-6

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs of ids (``a``, ``b``), those whose sketches allow the limit, with the places that differ."""
        for c in ("a", "b"):
            side = self.texts.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
            pairs = pairs.join(side, c)
        h = _differing(F.col("sketch_a"), F.col("sketch_b"))
        return pairs.withColumn("h", h).where(F.col("h") <= self.apart(F.col("size_a"), F.col("size_b"))).select("a", "b", "h")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs of ids whose sets overlap enough. Texts are fetched by key, behind a Bloom filter."""
        pairs = self.scratch.put(pairs.select("a", "b").distinct(), "pairs")
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = self.scratch.put(wanted.join(self.texts.select("id", "key"), "id"), "wanted")
        keys = wanted.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct()
        texts = having(self.rows, F.col("key").cast("string"), keys, "key")
        if self.nameless:
            texts = texts.unionByName(self.rows.where("key IS NULL"))
        shingle = self.shingle

        def sets(batches):
            known = _Words()
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    words = [words_of(batch.column(0)[i].as_py()) for i in range(start, min(start + 256, batch.num_rows))]
                    made = [shingles_of(w, shingle, known).view(np.int64) for w in words]
                    offsets = pa.array(np.cumsum([0, *map(len, made)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([identity_of(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(made)))], names=["id", "own"])

        own = texts.select("text").mapInArrow(sets, "id bigint, own array<bigint>").join(wanted.select("id"), "id", "left_semi")
        own = self.scratch.put(own.groupBy("id").agg(F.first("own").alias("own")), "sets")
        both = pairs.join(own.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        alike = shared >= F.lit(self.similar) * (F.size("x") + F.size("y") - shared)
        found = self.scratch.put(both.where(alike).select("a", "b"), name)
        self.scratch.drop("sets", "wanted", "pairs")
        return found

    def by_prints(self) -> DataFrame:
        """Pairs of representatives of equal and of near fingerprints."""
        some = self.texts.where("size > 0")
        prints = self.scratch.put(some.groupBy(F.col("print").alias("fingerprint")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "prints")
        count = prints.count()
        sample = bounded_sample(prints.select("fingerprint"), SAMPLE)
        parts = plan_parts(np.array([r["fingerprint"] for r in sample], np.int64).view(np.uint64), count)
        first = lambda c: prints.select(F.col("fingerprint").alias(c), F.col("first").alias(f"first_{c}"))
        near = links(prints, parts).join(first("a"), "a").join(first("b"), "b").select("first_a", "first_b")
        same = some.join(prints.where("n > 1"), F.col("print") == F.col("fingerprint")).where("id <> first").select("id", "first")
        return _named(near.union(same), "first_a", "first_b")

    def shared(self) -> DataFrame:
        """The rows of the prefixes whose shingle several texts have, one of them of a size that allows the limit."""
        counts = self.rows.sparkSession.sparkContext.broadcast(counts_of(self.rows.select("text"), self.shingle))
        all_ = Window.partitionBy("shingle")
        by_size = all_.orderBy("place")
        rows = _prefixes(self.rows, self.shingle, self.similar, counts)
        rows = rows.withColumns({"least": F.min("id").over(all_), "most": F.max("id").over(all_), "smaller": F.lag("place").over(by_size), "larger": F.lead("place").over(by_size)})
        fits = (_size(F.col("smaller")) >= self.similar * _size(F.col("place")) - 1e-6) | (_size(F.col("place")) >= self.similar * _size(F.col("larger")) - 1e-6)
        out = self.scratch.put(rows.where((F.col("least") < F.col("most")) & fits).groupBy("shingle", "id").agg(F.first("place").alias("place")), "shared")
        counts.unpersist()
        return out


def _size(place: Column) -> Column:
    return F.call_function("shiftright", place, F.lit(32))


def _named(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs ``a`` > ``b`` of two columns."""
    return pairs.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a > b").distinct()


def _differing(x: Column, y: Column) -> Column:
    """In how many places two sketches differ."""
    out = F.lit(0)
    for k in range(SKETCH):
        out = out + F.bit_count(x[k].bitwiseXOR(y[k]))
    return out


def _closest(pairs: DataFrame) -> DataFrame:
    """For each ``a`` the ``b`` with the closest sketch."""
    return pairs.groupBy("a").agg(F.min(F.struct("h", "b")).alias("to")).select("a", F.col("to.b").alias("b"))


def _grouped(docs: DataFrame, key: str, text: str, shingle: int, similar: float) -> DataFrame:
    """``key``, ``id`` (of the text), ``root`` (of the group) and ``component_id`` of every row."""
    it = _Texts(small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text")), shingle, similar)
    scratch = it.scratch
    met = it.shared()
    found = it.verified(_closest(it.near(it.by_prints())), "links-0")
    scratch.drop("prints")

    def tagged(found: DataFrame) -> DataFrame:
        roots = components(found, scratch=scratch).withColumnRenamed("node", "id")
        return met.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))

    for k in range(1, ROUNDS + 1):
        over = Window.partitionBy("shingle").orderBy(F.xxhash64("id", "shingle", F.lit(k)), "id")
        before = tagged(found).withColumn("before", F.lag(F.struct("id", "place", "root")).over(over))
        before = before.where((F.col("before.root") != F.col("root")) & it.enough(F.col("place"), F.col("before.place")))
        tried = _closest(it.near(_named(before, "id", "before.id")))
        found = scratch.put(found.unionByName(it.verified(tried, "tried")), f"links-{k}")
        scratch.drop("tried", f"links-{k - 1}")

    all_ = Window.partitionBy("shingle")
    inside = tagged(found).withColumns({"least": F.min("root").over(all_), "most": F.max("root").over(all_)}).where("least < most").drop("least", "most")
    inside = scratch.put(inside.join(it.texts.select("id", "size", "sketch"), "id"), "inside")
    scratch.drop("shared")
    g, h = inside.alias("g"), inside.alias("h")
    meets = (F.col("g.shingle") == F.col("h.shingle")) & (F.col("g.root") < F.col("h.root")) & it.enough(F.col("g.place"), F.col("h.place"))
    meets = meets & (_differing(F.col("g.sketch"), F.col("h.sketch")) <= it.apart(F.col("g.size"), F.col("h.size")))
    rest = it.verified(_named(g.join(h, meets), "g.id", "h.id"), "rest")
    scratch.drop("inside")
    stars = components(found.unionByName(rest), scratch=scratch)
    rooted = it.texts.select("id", "key").join(stars, F.col("id") == F.col("node"), "left").select("id", "key", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("key").alias("component_id"))
    named = scratch.put(rooted.join(least, "root").select("id", "root", "component_id"), "named")
    out = scratch.put(it.features.select("key", "id").join(named, "id").select("key", "id", "root", "component_id"), "groups")
    scratch.drop(*[n for n in scratch.paths if n != "groups"])
    return out


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """``key`` and ``component_id``, the smallest key that links of at least ``similar`` can reach, of every row."""
    return _grouped(docs, key, text, shingle, similar).select(F.col("key").alias(key), "component_id")


def _identified(rows: DataFrame, text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(text))
            ids = [identity_of(words_of(source[i].as_py())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=[*batch.schema.names, f"{OWN}id"])

    return rows.mapInArrow(run, f"{ddl(rows)}, {OWN}id bigint")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """One row of each group: one that has its smallest key (null, if all are) and, of the texts with that key in the group,
    the smallest identity. Texts never go because they share a key with others. Only where some rows of a key go and others
    stay are that key's rows told apart by their texts; the rest are filtered in place by the keys that go."""
    groups = _grouped(docs, key, text, shingle, similar)
    scratch = Scratch(docs.sparkSession, "one-of-each")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "id")).alias("kept"))
    groups = groups.join(first.select("root", F.col("kept.key").alias("kept_key"), F.col("kept.id").alias("kept_id")), "root")
    stays = F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("id") == F.col("kept_id"))
    keys = groups.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.when(stays, F.col("id"))).alias("stay"), F.sort_array(F.collect_set(F.when(stays, F.col("id")))).alias("ids"))
    changed = scratch.put(keys.where("key IS NULL OR stay < rows"), "changed")
    name, none = F.col(key).cast("string"), F.col(key).isNull()
    gone = changed.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key"))
    out = lacking(docs.where(~none), name, gone, "key")
    mixed = changed.where("stay > 0").select("key", F.explode("ids").alias("id"))
    if mixed.limit(1).count():
        asked = mixed.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key")).distinct()
        told = _identified(having(docs, name, asked, "key").unionByName(docs.where(none)), text)
        own = mixed.select(F.col("key").alias(f"{OWN}key"), F.col("id").alias(f"{OWN}kept"))
        told = told.join(own, F.col(key).eqNullSafe(F.col(f"{OWN}key")) & (F.col(f"{OWN}id") == F.col(f"{OWN}kept")), "left_semi")
        out = out.unionByName(told.dropDuplicates([key, f"{OWN}id"]).drop(f"{OWN}id"))
    return out
