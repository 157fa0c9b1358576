"""SentencePiece encoding and decoding by a Viterbi pass that words with a common beginning share.

A text becomes marked words (``▁`` stands for a space and opens each word). The distinct words of a batch are sorted,
which lays them out as the paths of a trie in depth-first order: going from one word to the next, the forward states of
their common prefix stay, and only the rest is computed. A state is the best segmentation of a prefix: its score and its
last piece.

The score is the sum of the pieces' scores. For a merge model (BPE) the greatest sum is not what its merges give, so there a
step from one piece to the next is allowed only if merging the two pieces' joined text gives back just those two; one
allowed step to each prefix remains, its score is carried on, and the path is the library's own result.

Defined results: a null text has null ids and decodes to null; an empty text has no ids and decodes to an empty text.
Characters without a piece become byte pieces. A literal ``▁`` decodes to a space, as in the library. Repeated rows
give equal ids. Columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, drop_clashing, small_batches, spread, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces and of models in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: A worker forgets the ids of the words that it has seen when they are more than this, or longer together.
KEPT_WORDS, KEPT_CHARS = 120_000, 6_000_000
#: Pairs of pieces that a worker remembers as fitting or not.
KEPT_STEPS = 200_000
#: Texts are handled in groups of about so many characters.
GROUP_CHARS = 2 << 20


def _fields(data: bytes):
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """A model file's pieces, and encoding and decoding with them."""

    def __init__(self, model: bytes):
        self.names: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.prefix, self.escape, identity = UNIGRAM, True, True, True
        for f, v in _fields(model):
            if f == 1:
                d = dict(_fields(v))
                self.names.append(d[1].decode())
                self.scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                self.kinds.append(d.get(3, NORMAL))
            elif f == 2:
                self.model_type = dict(_fields(v)).get(3, UNIGRAM)
            elif f == 3:
                d = dict(_fields(v))
                self.prefix, self.escape = bool(d.get(3, 1)), bool(d.get(5, 1))
                identity = not d.get(2) and not d.get(4, 1)
        if not identity or self.model_type not in (UNIGRAM, MERGES) or not self.escape:
            raise ValueError("only models with identity normalisation that keep spaces are read")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                tails.setdefault(p[-2:], {1}).add(2 if len(p) == 2 else 1)
        for p in self.ids:
            if len(p) > 2:
                tails.setdefault(p[-3:], set(tails[p[-2:]])).add(len(p))
        #: Lengths of the pieces that can end in three, or else in two characters, longest first.
        self.tails = {t: tuple(sorted(n, reverse=True)) for t, n in tails.items()}
        self.unknown_score = min(self.scores) - 10
        plain = [p.encode() if k in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(self.names, self.kinds, strict=True)]
        self.plain = np.array([p.replace(MARK.encode(), b" ") for p in plain], dtype=object)
        # words may be cut before a mark, and around line ends, where no piece reaches across
        whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        lines = not any("\n" in p and len(p) > 1 for p in self.ids)
        self.cut = re.compile("(?s).+" if whole else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if lines else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.fits: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Empties the table of words: their numbers, the count of each word's ids, and all ids one after another."""
        self.number: dict[str, int] = {}
        self.chars = 0
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    # -- merging, for the steps that a merge model allows

    def merged(self, text: str) -> list[str]:
        """What merging the characters of a short text gives: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best[0]):
                    best = (self.scores[k], i)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def step(self, last: int, piece: int) -> bool:
        """Whether one piece may follow another; START may be followed by what opens a word, OTHER is any character
        without a piece, which never merges."""
        key = last * len(self.names) + piece
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > KEPT_STEPS:
                self.fits.clear()
            pair = [self.names[last], self.names[piece]] if last >= 0 else [self.names[piece]]
            found = self.fits[key] = self.merged("".join(pair)) == pair
        return found

    # -- the shared forward pass

    def segment(self, words: list[str]):
        """The ids of each of ``words``, which must be sorted."""
        score, last, size = [0.0], [START], [0]  # by length of the prefix
        ids, scores, tails, merges, fits, step, width = self.ids, self.scores, self.tails, self.model_type == MERGES, self.fits, self.step, len(self.names)
        unknown_score = self.unknown_score
        before = ""
        for word in words:
            common, most = 0, min(len(before), len(word))
            while common < most and before[common] == word[common]:
                common += 1
            del score[common + 1 :], last[common + 1 :], size[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                best, which, long = None, OTHER, 1
                for n in tails.get(word[end - 3 : end] if end > 2 else "") or tails.get(word[end - 2 : end] if end > 1 else "", ONE):
                    if n > end:
                        continue
                    k = ids.get(word[end - n : end])
                    if k is None:
                        if n > 1:
                            continue
                        k = OTHER
                    elif merges:
                        fit = fits.get(last[end - n] * width + k)
                        if fit is None:
                            fit = step(last[end - n], k)
                        if not fit:
                            continue
                    value = score[end - n] + (scores[k] if k != OTHER else unknown_score)
                    if best is None or value > best:
                        best, which, long = value, k, n
                    if merges:
                        break  # no other step is allowed
                score.append(best)
                last.append(which)
                size.append(long)
            before = word
            out, end = [], len(word)
            while end:
                k = last[end]
                if k != OTHER:
                    out.append(k)
                elif self.bytes:
                    out += [self.bytes[b] for b in reversed(word[end - 1].encode())]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
                end -= size[end]
            yield out[::-1]

    def marked(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's begin (and the last one's end)."""
        if len(self.number) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.forget()
        number, known = self.number, len(self.number)
        spots, sizes = [], []
        for text in texts:
            words = self.cut.findall(self.marked(text))
            sizes.append(len(words))
            spots.append([number.setdefault(w, len(number)) for w in words])
        new = list(itertools.islice(number, known, None))
        self.chars += sum(map(len, new))
        order = sorted(range(len(new)), key=new.__getitem__)
        found: list = [None] * len(new)
        for i, parts in zip(order, self.segment([new[i] for i in order]), strict=True):
            found[i] = parts
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, found), np.int64, len(found))])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), np.int32)])
        begins = np.cumsum(self.lengths) - self.lengths
        use = np.fromiter(itertools.chain.from_iterable(spots), np.int64, sum(sizes))
        counts = self.lengths[use]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(begins[use] - (ends - counts), counts) + np.arange(int(counts.sum()))]
        limits = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[limits]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> str:
        text = b"".join(self.plain[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


ONE = (1,)
#: In place of a piece: nothing yet, and a character without a piece.
START, OTHER = -2, -1
_LOADED: dict[str, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model, parsed once in a Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _groups(texts: pa.Array):
    """(first row, rows) of pieces of a batch with about GROUP_CHARS bytes of text each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held > GROUP_CHARS or i == len(sizes) - 1:
            yield start, i + 1 - start
            start, held = i + 1, 0


def encode(docs: DataFrame, text: str = "text", model_path: str = MODEL_PATH, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_tokens`` of each whole text. The model file is read by the driver and
    sent along (half a megabyte), so executors need no file of their own; nothing is shuffled. With ``decoded``, also
    the text of the ids, as ``decode`` gives it, made by the same worker instead of a second one beside it."""
    model = Path(model_path).read_bytes()
    names = ["ids", "n_tokens", *(["decoded"] if decoded else [])]
    docs = small_batches(drop_clashing(docs, names))

    def run(batches):
        pieces = loaded(model)
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(text))
            for start, count in _groups(source):
                part, texts = batch.slice(start, count), source.slice(start, count).to_pylist()
                ids, ends = pieces.encode_batch([t or "" for t in texts])
                if ends[-1] > 2**31 - 1:
                    raise ValueError("a group of texts has more tokens than an Arrow list holds")
                null = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=null)
                made = [lists, pa.array(np.diff(ends))]
                if decoded:
                    made.append(pa.array([None if t is None else pieces.decode(ids[ends[i] : ends[i + 1]]) for i, t in enumerate(texts)], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])
        pieces.forget()  # an idle worker holds no words

    return docs.mapInArrow(run, f"{ddl(docs)}, ids array<int>, n_tokens bigint{', decoded string' if decoded else ''}")


def decode(encoded: DataFrame, ids: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """``encoded`` with ``decoded``, the text of the ids; ids that the model doesn't have raise an error."""
    model = Path(model_path).read_bytes()
    encoded = drop_clashing(encoded, ["decoded"])

    def run(batches):
        pieces = loaded(model)
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(ids))
            texts = [pieces.decode(x.values.to_numpy()) if (x := source[i]).is_valid else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{ddl(encoded)}, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    """Encodes every whole text, decodes the ids again, and says whether that gave the text back."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    seen = encode(docs, decoded=True)
    return seen.select("doc_id", "n_tokens", "ids", F.crc32(F.encode("decoded", "UTF-8")).alias("decoded_crc32"), F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))
