"""Language-model scoring by cross-entropy difference (after Moore and Lewis, 2010).

Two models of the same order, smoothing and vocabulary are counted: the target model on the documents that a label
marks as good, the background model on all documents. A document's score is the mean, over its tokens, of the loss of
the target model less the loss of the background model; the lower, the more it is like the target.

A token is a character (a code point, as it is) or the border of a text, so the vocabulary is closed and shared, and no
script or letter is folded into another. All four-grams of all texts are counted for both models, into a table that
grows with the corpus; nothing in it is cut or merged. Losses are computed from it in DataFrame steps, each order smoothed
by the one below.

Texts are dealt, as they come, into groups of about GROUP_CHARS characters. The distinct grams of each group, with their
counts in it, are one table: summed by gram it gives the counts of the corpus, and joined by gram with the losses it gives each
group just the losses that its texts need. A group's texts and its losses then meet in one task. So no task and no driver
ever holds the model, only the grams of one group, and grams that many texts share travel once for each group.

Defined results: a null or empty text has no tokens, and null losses and score. Repeated rows count as often as they
occur and score alike. Without any target document the two models are alike and every score is zero. Columns named like
an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bloom import flagged
from .common import OWN, Scratch, ddl, drop_clashing, small_batches, spread, table

ORDER = 4
#: A context's own counts weigh against this many of what the shorter context says.
TRUST = 8.0
#: The border of a text: a number above all code points.
BORDER = 0x110000
#: Characters of a group of texts (at most twice as many, and fewer where tasks would stand idle), and tokens that are
#: counted at once.
GROUP_CHARS, LEAST_CHARS, TOKENS = 16_000_000, 2_000_000, 1 << 18
GRAM, GROUP = ["a", "b", "c", "d"], f"{OWN}group"


def grams_of(text: str) -> np.ndarray:
    """The four-gram that each token of a text ends (a row of ORDER code points): its characters and the border at the
    end, after borders at the start."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.full(len(raw) + ORDER, BORDER, np.uint32)
    s[ORDER - 1 : -1] = raw
    return np.lib.stride_tricks.sliding_window_view(s, ORDER)


class Alphabet:
    """The distinct tokens of some texts, numbered, so that a gram of them is one exact number: the numbers of its tokens,
    in as few bits as they need. Texts of more than 2^16 different characters don't fit and are refused; a group of texts
    is closed before it has so many."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.union1d(tokens, [BORDER]).astype(np.uint32)
        self.bits = max(1, int(len(self.tokens) - 1).bit_length())
        if ORDER * self.bits > 64:
            raise ValueError("a group of texts has too many different characters")

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        """The number of the gram that each token ends, from the tokens' numbers after ORDER - 1 borders."""
        n = len(numbers) - ORDER + 1
        out = np.zeros(n, np.uint64)
        for k in range(ORDER):
            out = (out << np.uint64(self.bits)) | numbers[k : k + n]
        return out

    def of_text(self, text: str) -> np.ndarray:
        return self.codes(np.searchsorted(self.tokens, tokens_of(text)).astype(np.uint64))

    def of_grams(self, grams: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(grams[0]), np.uint64)
        for column in grams:
            out = (out << np.uint64(self.bits)) | np.searchsorted(self.tokens, column.astype(np.uint32)).astype(np.uint64)
        return out

    def grams(self, codes: np.ndarray) -> list[np.ndarray]:
        low = np.uint64((1 << self.bits) - 1)
        return [self.tokens[(codes >> np.uint64(self.bits * (ORDER - 1 - k))) & low].astype(np.int32) for k in range(ORDER)]


class Group:
    """Texts of one group: their distinct characters and how many they have."""

    def __init__(self, most: int):
        self.seen, self.chars, self.most = np.zeros(0, np.uint32), 0, most

    def takes(self, text: str) -> bool:
        """Whether the text goes into this group; if so, it is counted in. An empty group takes any text."""
        fresh = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        both = np.union1d(self.seen, fresh)
        if self.chars and (self.chars + len(text) > self.most or len(both) >= 1 << 16):
            return False
        self.seen, self.chars = both, self.chars + len(text)
        return True


def tokens_of(text: str) -> np.ndarray:
    """The characters of a text and the border at its end, after ORDER - 1 borders."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.full(len(raw) + ORDER, BORDER, np.uint32)
    s[ORDER - 1 : -1] = raw
    return s


def dealt(docs: DataFrame, text: str = "text") -> DataFrame:
    """The ``docs`` that have a text, with the ``group`` of each: rows of one task in the order in which they come, so a group
    of copies is dealt like any others. Write the table before it is used twice."""
    docs = small_batches(docs.where(F.length(text) > 0))
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    groups = max(-(-total // GROUP_CHARS), min(-(-total // LEAST_CHARS), docs.sparkSession.sparkContext.defaultParallelism))
    docs = docs.coalesce(max(1, groups))  # small files are put together, so that their grams are
    column, most = docs.columns.index(text), 2 * GROUP_CHARS

    def run(batches):
        from pyspark import TaskContext

        group, number = Group(most), TaskContext.get().partitionId() << 32
        for batch in batches:
            source, numbers = batch.column(column), []
            for i in range(batch.num_rows):
                t = source[i].as_py()
                if not group.takes(t):
                    group, number = Group(most), number + 1
                    group.takes(t)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, GROUP])

    return docs.mapInArrow(run, f"{ddl(docs)}, {GROUP} bigint")


def counted(docs: DataFrame, text: str = "text", good: str | None = None) -> DataFrame:
    """The distinct four-grams (``a`` to ``d``) of each group of ``dealt`` texts, with how often they occur in those whose
    column ``good`` is true (``near``) and in all (``far``)."""
    rows = docs.select(F.col(text).alias("text"), (F.lit(True) if good is None else F.coalesce(good, F.lit(False))).alias("good"), GROUP)
    most = TOKENS

    def run(batches):
        number, held = None, []
        for batch in batches:
            at = batch.column(2).to_numpy()
            cuts = [0, *(np.nonzero(at[1:] != at[:-1])[0] + 1), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if held and at[a] != number:  # rows of a group stand together; one that is cut in two gives its grams twice
                        yield from _tally(held, number, most)
                        held = []
                    number = int(at[a])
                    held.append((batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)))
        if held:
            yield from _tally(held, number, most)

    return rows.mapInArrow(run, f"{GROUP} bigint, a int, b int, c int, d int, near bigint, far bigint")


def _tally(rows: list[tuple[pa.Array, pa.Array]], number: int, most: int):
    """The distinct grams of a group's texts, counted. Texts stay in Arrow's memory until it's their turn."""
    seen = np.zeros(0, np.uint32)
    for texts, _ in rows:
        for t in texts:
            seen = np.union1d(seen, np.unique(tokens_of(t.as_py())))
    alphabet, parts, held, size = Alphabet(seen), [], [], 0

    def add() -> None:
        codes, marks = np.concatenate([c for c, _ in held]), np.repeat([g for _, g in held], [len(c) for c, _ in held])
        near, near_n = np.unique(codes[marks], return_counts=True)
        far, far_n = np.unique(codes[~marks], return_counts=True)
        parts.append((np.concatenate([near, far]), np.concatenate([near_n, np.zeros(len(far), np.int64)]), np.concatenate([near_n, far_n])))
        held.clear()

    for t, good in ((t.as_py(), g.as_py()) for texts, flags in rows for t, g in zip(texts, flags, strict=True)):
        held.append((alphabet.of_text(t), good))
        size += len(t)
        if size >= most:
            add()
            size = 0
            if sum(len(p[0]) for p in parts) > 4 * most:
                parts = [_summed(parts)]
    if held:
        add()
    codes, near, far = _summed(parts)
    for at in range(0, len(codes), 100_000):
        part = slice(at, at + 100_000)
        columns = [np.full(len(codes[part]), number, np.int64), *alphabet.grams(codes[part]), near[part], far[part]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=[GROUP, *GRAM, "near", "far"])


def _summed(parts: list[tuple]) -> tuple:
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, *(np.bincount(at, np.concatenate([p[k] for p in parts]), len(codes)).astype(np.int64) for k in (1, 2))


def losses(counts: DataFrame) -> DataFrame:
    """``a`` to ``d`` and -log2 of the chance of ``d`` after the others, by either model: ``loss_near``, ``loss_far``. Each
    order is smoothed by the one below it, the lowest by equal chances. Without target counts both are the background."""
    p = None
    for k in range(ORDER - 1, -1, -1):
        gram, context = GRAM[k:], GRAM[k:-1]
        rows = counts.groupBy(*gram).agg(F.sum("near").alias("near"), F.sum("far").alias("far"))
        over = Window.partitionBy(*context) if context else Window.partitionBy(F.lit(0))
        rows = rows.withColumns({"all_near": F.sum("near").over(over), "all_far": F.sum("far").over(over)})
        if p is None:
            rows = rows.withColumns({"low_near": 1 / F.count(F.lit(1)).over(over), "low_far": 1 / F.count(F.lit(1)).over(over)})
        else:
            rows = rows.join(p, GRAM[k + 1 :])
        chance = lambda x: (F.col(x) + TRUST * F.col(f"low_{x}")) / (F.col(f"all_{x}") + TRUST)
        p = rows.select(*gram, chance("near").alias("low_near"), chance("far").alias("low_far"))
    return p.select(*GRAM, (-F.log2("low_near")).alias("loss_near"), (-F.log2("low_far")).alias("loss_far"))


def score(docs: DataFrame, text: str = "text", good: Column | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``loss_target``, ``loss_background`` (bits a token) and ``score`` of each text, by models
    counted on the same texts; ``good`` marks the target documents."""
    made = ["n_tokens", "loss_target", "loss_background", "score"]
    mark = f"{OWN}good"
    docs = docs.withColumn(mark, F.lit(True) if good is None else F.coalesce(good, F.lit(False)))
    docs = drop_clashing(docs, [c for c in made if c != text])
    names = [c for c in docs.columns if c != mark]
    scratch = Scratch(docs.sparkSession, "lm")
    texts = scratch.put(dealt(docs, text), "texts")
    grams = scratch.put(counted(texts, text, mark), "grams")
    sums = scratch.put(grams.groupBy(*GRAM).agg(F.sum("near").alias("near"), F.sum("far").alias("far")), "counts")
    told = scratch.put(losses(sums), "losses")  # its true size tells the planner how to join it
    if not (sums.agg(F.sum("near")).first()[0] or 0):
        told = told.withColumn("loss_near", F.col("loss_far"))
    needed = grams.select(GROUP, *GRAM).join(told, GRAM).select(GROUP, *GRAM, F.col("loss_near").cast("float").alias("near"), F.col("loss_far").cast("float").alias("far"))
    columns, at = texts.columns, texts.columns.index(text)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        near_far = np.zeros((2, left.num_rows))
        if right.num_rows:
            parts = [right.column(c).to_numpy() for c in GRAM]
            alphabet = Alphabet(np.unique(np.concatenate([np.unique(p) for p in parts])))
            codes, first = np.unique(alphabet.of_grams(parts), return_index=True)
            tables = [right.column(c).to_numpy()[first].astype(np.float64) for c in ("near", "far")]
            source = left.column(at)
            for i in range(left.num_rows):
                where = np.searchsorted(codes, alphabet.of_text(source[i].as_py()))
                for k in (0, 1):
                    near_far[k, i] = tables[k][where].sum()
        kept = [left.column(c) for c in columns if c not in (mark, GROUP)]
        return pa.Table.from_arrays([*kept, *map(pa.array, near_far)], names=[*names, f"{OWN}near", f"{OWN}far"])

    met = texts.groupBy(GROUP).cogroup(needed.groupBy(GROUP)).applyInArrow(run, f"{ddl(texts.select(*names))}, {OWN}near double, {OWN}far double")
    blank = docs.where(F.coalesce(F.length(text), F.lit(0)) == 0).select(*names, F.lit(0.0).alias(f"{OWN}near"), F.lit(0.0).alias(f"{OWN}far"))
    rows = met.unionByName(blank)
    length = F.coalesce(F.length(text), F.lit(0)).cast("long")
    tokens = F.when(length > 0, length + 1).otherwise(length)
    mean = lambda c: F.when(tokens > 0, F.col(c) / tokens)
    kept = [c for c in names if c.lower() not in made]
    rows = rows.select(*kept, tokens.alias("n_tokens"), mean(f"{OWN}near").alias("loss_target"), mean(f"{OWN}far").alias("loss_background"))
    return rows.withColumn("score", F.col("loss_target") - F.col("loss_background"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1")
    good = good.select(F.col("doc_id").cast("string").alias("id")).where("id IS NOT NULL").distinct()
    marked = flagged(docs, F.col("doc_id").cast("string"), good, "id", f"{OWN}good")
    return score(marked, good=F.col(f"{OWN}good")).select("doc_id", "n_tokens", "loss_target", "loss_background", "score")
