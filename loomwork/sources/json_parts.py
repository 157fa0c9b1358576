"""Reading one large JSON document in parts: one object whose fields are arrays of objects, in one file, or in the files of a
folder that tasks wrote side by side (``ndjson.write_document``), which put together in order of their paths are the document.

The file is cut at every ``}``, by as many tasks as it has splits, and the pieces stay where they are read: no text is shuffled.
A first pass tells of each split, for both cases of beginning inside a string or not, how deep it goes; from these few numbers
follows how each split begins. A second pass cuts each split wherever a brace comes back to the depth of the arrays, which
ends an element. Only the elements that reach over the bounds of splits are put together by a grouping; what stands before an
element tells whether a new array begins and how it is named. Elements are written as packed lines by collection and read as
such, so that schemas are inferred in parallel too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import folder

#: What stands before an element: all up to its first brace that isn't in a string; a field that begins an array.
_HEAD = r"""(?s)\A((?:[^"{]|"(?:[^"\\]|\\.)*+")*+)\{"""
_FIELD = r"""(?s)"((?:[^"\\]|\\.)*+)"\s*:\s*\["""

#: By byte: what it adds to the depth, and whether it matters at all.
_STEP = np.zeros(256, "int8")
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_MATTERS = _STEP != 0
_MATTERS[ord('"')] = True
#: Bits that number the elements of a split.
_BITS = 40


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of the pieces of a file, each without the brace that ends it, and ``part``, the number of their split. They
    stand in order in their splits. Of a folder's files, in order of their paths, each but the last must end at a brace. The
    blank rest after the last brace is left out. Only the counts of the splits come to the driver."""
    own = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size")]
    rows = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path).select(*own, F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    told = [F.max("id").alias("last"), F.sum(F.octet_length("text") + 1).alias("bytes"), F.max("size").alias("size")]
    splits = sorted(rows.groupBy("file", "start").agg(*told).collect(), key=lambda r: (r["file"], r["start"]))
    held: dict[str, int] = {}
    for r in splits:
        held[r["file"]] = held.get(r["file"], 0) + r["bytes"]
    if cut := [r["file"] for r in splits if r["file"] != splits[-1]["file"] and held[r["file"]] != r["size"]]:
        raise ValueError(f"{cut[0]} doesn't end at a brace")
    if splits:
        rows = rows.where(~((F.col("id") == splits[-1]["last"]) & F.col("text").rlike(r"\A\s*\z")))
    parts = spark.createDataFrame([(r["file"], r["start"], i) for i, r in enumerate(splits)], "file string, start long, part int")
    return rows.join(F.broadcast(parts), ["file", "start"], "left").select("part", "text")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Number, rows and bytes of each part that a batch holds rows of."""
    if not batch.num_rows:
        return
    if batch.column(0).null_count:
        raise ValueError("the splits of the document changed while it was read")
    parts, text = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_binary())
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, "int64")[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, "uint8")
    bounds = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield int(parts[a]), b - a, data[offsets[a] : offsets[b]]


def _brackets(data: np.ndarray, quoted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of all quotes and brackets, what each adds to the depth, whether an odd number of quotes (that aren't escaped)
    comes before it, and whether one comes before the end; ``quoted`` counts as the quotes before the text."""
    at = np.flatnonzero(_MATTERS[data])
    kind = data[at]
    quote = kind == ord('"')
    plain = data != ord("\\")
    if not plain.all():
        # a quote is escaped by an odd number of backslashes
        other = np.maximum.accumulate(np.where(plain, np.arange(len(data)), -1))
        before = np.maximum(at - 1, 0)
        quote &= ((at > 0) & ((before - other[before]) % 2 == 1)) == 0
    odd = (np.cumsum(quote) + quoted) & 1
    return at, _STEP[kind], odd == 1, int(odd[-1]) if len(odd) else quoted


def _tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: its pieces, whether its quotes are odd, and the depth that it adds if it begins outside of a string and inside."""
    found: dict[int, list[int]] = {}
    for batch in batches:
        for part, rows, data in _runs(batch):
            told = found.setdefault(part, [0, 0, 0, 0])
            _, step, inside, odd = _brackets(data, told[1])
            told[:] = told[0] + rows, odd, told[2] + int(step[~inside].sum(dtype="int64")), told[3] + int(step[inside].sum(dtype="int64"))
    yield pa.RecordBatch.from_pydict({"part": pa.array(found, pa.int32())} | {n: pa.array([t[i] for t in found.values()], pa.int64()) for i, n in enumerate(("rows", "odd", "deeper", "deeper_inside"))})


def _cut(starts: dict[int, tuple[int, int]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts parts after each brace that ends an element. ``starts``: whether a part begins inside a string, and how deep."""

    def made(part: int, n: int, begins: bool, data: bytes, ends: np.ndarray, ended: bool) -> pa.RecordBatch:
        offsets = np.concatenate([[0], ends]).astype("int32")
        text = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        numbers = (part << _BITS) + np.arange(n, n + len(ends))
        return pa.RecordBatch.from_pydict({"at": numbers, "begins": np.arange(len(ends)) >= (not begins), "ends": np.full(len(ends), ended), "text": text})

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, begins, quoted, depth, kept = -1, 0, True, 0, 0, []  # kept: what has come of an element that isn't ended
        rest = lambda: [made(now, n, begins, text, np.array([len(text)]), False)] if (text := b"".join(kept)) else []
        for batch in batches:
            for part, _, data in _runs(batch):
                if part != now:
                    yield from rest()
                    now, n, kept, (quoted, depth) = part, 0, [], starts[part]
                    begins = part == 0 or (quoted, depth) == (0, 2)
                at, step, inside, quoted = _brackets(data, quoted)
                at, step = at[~inside], step[~inside]
                deep = depth + np.cumsum(step, dtype="int64")
                depth = int(deep[-1]) if len(deep) else depth
                ends = at[(deep == 2) & (data[at] == ord("}"))] + 1
                if not len(ends):
                    kept.append(data.tobytes())
                    continue
                before = b"".join(kept)
                yield made(part, n, begins, before + data[: ends[-1]].tobytes(), ends + len(before), True)
                n, begins, kept = n + len(ends), True, [data[ends[-1] :].tobytes()]
        yield from rest()

    return cut


def _halves() -> tuple[Column, Column]:
    """What stands before an element and its object, of its whole ``text``; what doesn't end as one stands before it alone."""
    # the object around the arrays opens before the first element
    text = F.when(F.col("at") == 0, F.regexp_replace("text", r"\A\s*\{", "")).otherwise(F.col("text"))
    head = F.when(F.col("ends"), F.regexp_extract(text, _HEAD, 1)).otherwise(text)
    return head, F.when(F.col("ends"), F.substr(text, F.length(head) + 1))


def elements(cut: DataFrame, rows: int | None = None, to: str | None = None) -> DataFrame:
    """``at`` (a number that grows from element to element), ``head`` and ``body`` of all elements of the arrays, from the
    pieces. What is left after the last one comes as a row without a body. They are written to ``to``; ``rows``: how many
    pieces there must be."""
    spark, to = cut.sparkSession, to or folder(cut.sparkSession, "json")
    cut = cut.select("part", F.concat("text", F.lit("}")).alias("text"))
    told = sorted(cut.mapInArrow(_tell, "part int, rows long, odd long, deeper long, deeper_inside long").collect())
    if rows is not None and rows != (seen := sum(r["rows"] for r in told)):
        raise ValueError(f"{seen} pieces of {rows} were read")
    starts, quoted, depth = {}, 0, 0
    for r in told:
        starts[r["part"]] = quoted, depth
        quoted, depth = quoted ^ r["odd"], depth + r["deeper_inside" if quoted else "deeper"]
    whole = F.col("begins") & F.col("ends")
    head, body = _halves()
    segments = cut.mapInArrow(_cut(starts), "at long, begins boolean, ends boolean, text string")
    segments = segments.select("at", "begins", "ends", F.when(whole, head).alias("head"), F.when(whole, body).otherwise(F.col("text")).alias("body"))
    segments.write.option("compression", "zstd").parquet(f"{to}/kind=cut")
    # of an element that reaches over bounds of splits, the first segment begins it
    loose, owners, owner = spark.read.parquet(f"{to}/kind=cut").where(~whole), [], 0
    for r in sorted(loose.select("at", "begins").collect()):
        owner = r["at"] if r["begins"] else owner
        owners.append((r["at"], owner))
    owners = F.broadcast(spark.createDataFrame(owners, "at long, owner long"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda s: s["body"])
    joined = loose.join(owners, "at").groupBy(F.col("owner").alias("at")).agg(F.array_join(texts, "").alias("text"), F.max("ends").alias("ends"))
    joined.select("at", F.lit(True).alias("begins"), F.lit(True).alias("ends"), head.alias("head"), body.alias("body")).write.parquet(f"{to}/kind=joined")
    return spark.read.parquet(to).where(whole).select("at", "head", "body")


def read_parts(spark: SparkSession, path: str, joined: bool = False) -> dict[str, DataFrame] | None:
    """The collections of a file (or of the files of a folder, which are one document if they are ``joined``), or None where
    there is anything but arrays of objects."""
    at = folder(spark, "json")
    documents = [path] if joined else spark.read.text(path).inputFiles()
    if not documents:
        raise ValueError(f"{path} holds no JSON")
    for k, name in enumerate(documents):
        elements(pieces(spark, name), to=f"{at}/elements/file={k}")
    every = spark.read.parquet(f"{at}/elements").where("begins AND ends").select("file", "at", "head", "body")
    # between elements there are commas, and where arrays end and begin, their fields
    if every.where(F.regexp_replace("head", _FIELD, "").rlike(r"[^\s,\]}]")).limit(1).count():
        return None
    fields = F.regexp_extract_all("head", F.lit(_FIELD), F.lit(1))
    named = every.select("file", "at", fields.alias("fields"), F.col("body").isNotNull().alias("closed")).where("cardinality(fields) > 0").orderBy("file", "at").collect()  # a row for each array
    decode = lambda x: __import__("json").loads(f'"{x}"')
    names = list(dict.fromkeys(decode(f) for r in named for f in r["fields"]))
    # of the arrays that begin before an element, the last one is its own
    spans: dict[str, list[str]] = {}
    for r, after in zip(named, [*named, None][1:], strict=True):
        until = f" AND at < {after['at']}" if after and after["file"] == r["file"] else ""
        if r["closed"]:
            spans.setdefault(decode(r["fields"][-1]), []).append(f"(file = {r['file']} AND at >= {r['at']}{until})")
    out = {}
    for i, name in enumerate(names):
        if name not in spans:
            out[name] = spark.createDataFrame([], "value string")
            continue
        lines = every.where(" OR ".join(spans[name])).where("body IS NOT NULL").select(F.regexp_replace("body", r"[\r\n]+", " ").alias("value"))
        lines.write.option("compression", "gzip").text(f"{at}/lines/{i}")
        out[name] = spark.read.json(f"{at}/lines/{i}")
    return out
