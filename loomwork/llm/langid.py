"""Language identification by a byte convolutional network, trained in numpy and applied to batched windows.

A text's UTF-8 bytes are cut into windows of fixed length. Each byte has a learned vector; filters of several widths
slide over them, the largest answer of each filter in the window is kept (max pooling), and a softmax over the
languages reads those. A text's probabilities are the mean over all its windows, weighted by the bytes in each.

Defined results: a null text, an empty one and one without a letter give ``und`` with score 0. Text outside UTF-8 can't
occur in a string column. Repeated rows give equal answers. With no labelled row to learn from, every text is ``und``.
Columns named like an output are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import OWN, ddl, drop_clashing, small_batches, spread, table

#: Bytes of a window, and how many windows go through the network at once.
WINDOW, BATCH = 256, 256
#: Widths of the filters, filters of each width, and size of a byte's vector.
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), (8, 12, 12), 8
#: Bound of the training sample: different labelled texts of each language (all of their text is learned from).
TRAIN_ROWS = 120
UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text has a letter (categories L). Python's word characters hold other numbers too, such as superscripts."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))



@dataclass
class Network:
    labels: list[str]
    table: np.ndarray  # 256 x EMBEDDING; byte 0 pads and stays zero
    filters: np.ndarray  # widest * EMBEDDING x all filters; a narrow filter is zero beyond its width
    shift: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns of bytes' vectors, answers of the filters at each position, and their largest, of (n, WINDOW) bytes."""
        n, widest = len(windows), max(WIDTHS)
        padded = np.zeros((n, WINDOW + widest - 1), np.uint8)
        padded[:, :WINDOW] = windows
        vectors = self.table[padded]
        seen = np.lib.stride_tricks.sliding_window_view(vectors, widest, axis=1)  # n, WINDOW, EMBEDDING, widest
        columns = np.ascontiguousarray(seen.transpose(0, 1, 3, 2)).reshape(n * WINDOW, widest * EMBEDDING)
        answers = (columns @ self.filters).reshape(n, WINDOW, -1)
        return columns, answers, answers.max(axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for at in range(0, len(windows), BATCH):
            top = self.pooled(windows[at : at + BATCH])[2]
            out[at : at + BATCH] = softmax(np.maximum(top + self.shift, 0) @ self.weights + self.bias)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mask() -> np.ndarray:
    """Which weights a filter of each width has."""
    rows = np.arange(max(WIDTHS) * EMBEDDING)[:, None] // EMBEDDING
    return (rows < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], epochs: int = 6, seed: int = 7) -> Network:
    """Fits a network to (n, WINDOW) bytes and label numbers by Adam on the cross entropy, classes weighted alike.
    The same input gives the same network."""
    rng = np.random.default_rng(seed)
    mask, filters = _mask(), sum(FILTERS)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = Network(names, draw(256, EMBEDDING, scale=0.5), draw(*mask.shape, scale=0.3) * mask, np.zeros(filters, np.float32), draw(filters, len(names), scale=0.3), np.zeros(len(names), np.float32))
    net.table[0] = 0
    share = np.bincount(labels, minlength=len(names)).astype(np.float32)
    weight = (len(labels) / len(names) / np.maximum(share, 1))[labels]
    params = ["table", "filters", "shift", "weights", "bias"]
    first = {p: np.zeros_like(getattr(net, p)) for p in params}
    second = {p: np.zeros_like(getattr(net, p)) for p in params}
    step, size, widest = 0, 64, max(WIDTHS)
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        rate = 0.01 * (0.5 if epoch >= epochs // 2 else 1)
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            x, y, n = windows[pick], labels[pick], len(pick)
            columns, answers, top = net.pooled(x)
            hidden = np.maximum(top + net.shift, 0)
            slope = softmax(hidden @ net.weights + net.bias)
            slope[np.arange(n), y] -= 1
            slope *= (weight[pick] / n)[:, None]
            back = (slope @ net.weights.T) * (hidden > 0)
            where = answers.argmax(axis=1) + np.arange(n)[:, None] * WINDOW  # n x filters: the row of columns that won
            used = columns[where]  # n, filters, widest * EMBEDDING
            by_column = back[:, :, None] * (net.filters * mask).T[None]
            padded = np.zeros((n, WINDOW + widest - 1), np.int64)
            padded[:, :WINDOW] = x
            spots = padded[np.arange(n)[:, None, None], (where % WINDOW)[:, :, None] + np.arange(widest)]
            table = np.zeros_like(net.table)
            np.add.at(table, spots.reshape(-1), by_column.reshape(-1, EMBEDDING))
            table[0] = 0
            slopes = {"table": table, "filters": np.einsum("nfc,nf->cf", used, back) * mask, "shift": back.sum(0), "weights": hidden.T @ slope, "bias": slope.sum(0)}
            step += 1
            for p in params:
                first[p] = 0.9 * first[p] + 0.1 * slopes[p]
                second[p] = 0.999 * second[p] + 0.001 * slopes[p] ** 2
                getattr(net, p)[...] -= rate * (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(raw: bytes) -> np.ndarray:
    """All of a text's bytes as (n, WINDOW), zeros at the end; no row for none."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def training_windows(texts: list[str], labels: list[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """All windows of each text, some of them cut short, as short texts and ends of texts are."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    rows, which = [], []
    for text, label in zip(texts, labels, strict=True):
        windows = windows_of(text.encode()).copy()
        for i in np.nonzero(rng.random(len(windows)) < 0.4)[0]:
            windows[i, int(rng.integers(8, WINDOW)) :] = 0
        rows.append(windows)
        which.append(np.full(len(windows), names.index(label), np.int64))
    return np.concatenate(rows), np.concatenate(which), names


def fit(docs: DataFrame, usable: Column, text: str = "text", label: str = "lang") -> Network | None:
    """A network learned from at most TRAIN_ROWS different usable labelled texts of each language, those of the smallest
    hashes, whatever the size of the table and whatever its keys. Only sample rows reach the driver, and a count for each
    language. Copies of a text count once, so no group of them can fill or empty the sample."""
    known = docs.filter(usable & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(label).alias("label"), F.col(text).alias("text"))
    chance = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.approx_count_distinct("text").alias("n")).collect()}
    if not counts:
        return None
    # twice the bound by an estimate, of which the first by hash are kept
    shares = F.map_from_arrays(F.array(*map(F.lit, sorted(counts))), F.array(*[F.lit(min(1.0, 2 * TRAIN_ROWS / max(1, counts[n]))) for n in sorted(counts)]))
    some = known.where(chance <= F.try_element_at(shares, "label")).distinct()
    first = F.row_number().over(Window.partitionBy("label").orderBy(chance, "text"))
    rows = some.withColumn("__first", first).where(F.col("__first") <= TRAIN_ROWS).select("text", "label").collect()
    rows = sorted(rows, key=lambda r: (r["label"], r["text"]))
    return train(*training_windows([r["text"] for r in rows], [r["label"] for r in rows]))


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the mean probability of that language) for every whole text.

    Rows are handled in Arrow batches by tasks that hold nothing but the small network; nothing is shuffled.
    """
    names = ["lang_pred", "score"]
    docs = small_batches(drop_clashing(docs, names))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            answers: list[tuple[str, float]] = []
            for at in range(0, len(texts), 512):
                answers += predict(net, texts[at : at + 512])
            made = [pa.array([a[0] for a in answers], pa.string()), pa.array([a[1] for a in answers], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, f"{ddl(docs)}, lang_pred string, score double")


def predict(net: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    live = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
    if not live:
        return out
    raws = [texts[i].encode() for i in live]
    total = np.zeros((len(live), len(net.labels)))
    owner, size, held, rows = [], [], 0, []
    for k, raw in enumerate([*raws, None]):
        if rows and (raw is None or held > 64 * BATCH):  # a bounded number of windows at once
            p = net.probabilities(np.concatenate(rows)) * np.concatenate(size)[:, None]
            np.add.at(total, np.concatenate(owner), p)
            owner, size, held, rows = [], [], 0, []
        if raw is not None:
            w = windows_of(raw)
            rows.append(w)
            owner.append(np.full(len(w), k))
            size.append(np.minimum(WINDOW, len(raw) - WINDOW * np.arange(len(w))).astype(np.float32))
            held += len(w)
    total /= total.sum(axis=1, keepdims=True)
    best = total.argmax(axis=1)
    for k, i in enumerate(live):
        out[i] = (net.labels[best[k]], float(min(1.0, total[k, best[k]])))
    return out


def held_out(key: Column) -> Column:
    """Whether the label of a row may not be learned from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    out = held_out(F.col("doc_id"))
    net = fit(docs, ~out)
    seen = identify(docs.select("doc_id", "text", out.alias(f"{OWN}held")), net)
    return seen.select("doc_id", F.col(f"{OWN}held").alias("held_out"), "lang_pred", "score")
