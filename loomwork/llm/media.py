"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, stored as NPY tiles with
difference hashes.

Defined results: null media, or bytes that no decoder reads, give null columns and an ``error`` text (null for good
media). Images without pixels are such an error. Columns of the input stay; those named like an output are replaced.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, drop_clashing

#: Side of the square NPY tiles, and samples a row of media that hold a text.
TILE, TEXT_WIDTH = 32, 64
#: Output batches are cut at about this many bytes.
BATCH_BYTES = 8 << 20

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    at, found = 2, []
    while len(found) < count:
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("the Netpbm header is cut")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """Samples of P1 to P6 as (height, width) or (height, width, 3); uint8, or uint16 for a maximum over 255.
    Bitmaps give 0 for black and 255 for white."""
    kind = data[1:2]
    bits, colour, raw = kind in b"14", kind in b"36", kind in b"456"
    (width, height, *top), at = _header(data, 2 if bits else 3)
    top = top[0] if top else 1
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise ValueError("the Netpbm header holds no picture")
    shape = (height, width, 3) if colour else (height, width)
    count = int(np.prod(shape))
    if not raw:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        words = [bytes([b]) for b in body if b in b"01"] if bits else body.split()
        if len(words) < count:
            raise ValueError("samples are missing")
        samples = np.array(words[:count], dtype=np.int64)
    else:
        at += 1
        if bits:
            stride = (width + 7) // 8
            rows = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
            samples = np.unpackbits(rows, axis=1)[:, :width]
        else:
            samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at)
    if bits:
        return ((1 - samples.reshape(shape)) * 255).astype(np.uint8)
    if int(samples.max()) > top:
        raise ValueError("a sample is above the stated maximum")
    return samples.reshape(shape).astype(np.uint8 if top < 256 else np.uint16)


#: Masks of red, green and blue that a BMP without masks of its own has.
MASKS = {16: (0x7C00, 0x3E0, 0x1F), 32: (0xFF0000, 0xFF00, 0xFF)}


def _field(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask as samples from 0 to 255."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return np.floor(((values & mask) >> low).astype(np.float64) * 255 / most + 0.5).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Samples of an uncompressed BMP of 1, 4 or 8 (palette), 16, 24 or 32 bits, with bit masks or without, as (height,
    width, 3), top row first, red first."""
    start, info = int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
    width, height = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packing = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    masked = packing == 3 and bits in MASKS
    if width < 1 or not height or bits not in (1, 4, 8, 16, 24, 32) or packing != 0 and not masked:
        raise ValueError("this kind of BMP is not read")
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits <= 8:
        colours = int.from_bytes(data[46:50], "little") or 1 << bits
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + info).reshape(-1, 4)
        places = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
        return palette[places[:, :width]][:, :, 2::-1].copy()
    if bits == 24:
        return rows[:, : width * 3].reshape(abs(height), width, 3)[:, :, ::-1].copy()
    values = np.ascontiguousarray(rows).view("<u2" if bits == 16 else "<u4")[:, :width].astype(np.int64)
    masks = np.frombuffer(data, "<u4", 3, 54).tolist() if masked else MASKS[bits]
    return np.stack([_field(values, m) for m in masks], axis=2)


def decode(data: bytes) -> np.ndarray:
    if re.match(rb"P[1-6][\s#]", data[:3]):
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A raw 8-bit Netpbm picture of (height, width) samples."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell of a height x width grid laid over ``samples`` (2-D), as float64.

    The integral image gives the sum above and left of any whole position; its values between two are interpolated,
    which is exact as each sample is constant over its own square.
    """
    h, w = samples.shape
    total = np.zeros((h + 1, w + 1), np.float64)
    np.cumsum(samples, axis=0, dtype=np.float64, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])
    for axis, (n, m) in enumerate(((h, height), (w, width))):
        edge = np.arange(m + 1) * (n / m)
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low).reshape((-1, 1) if axis == 0 else (1, -1))
        total = np.take(total, low, axis) * (1 - part) + np.take(total, low + 1, axis) * part
    return np.diff(np.diff(total, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(grey: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 area means is above its left neighbour."""
    cells = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def grey_of(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else samples @ np.array([0.299, 0.587, 0.114])


def tile_of(samples: np.ndarray, side: int = TILE) -> bytes:
    """The picture area-resized to side x side (x 3) uint8 or uint16 samples, as the bytes of an NPY file."""
    planes = samples[:, :, None] if samples.ndim == 2 else samples
    small = np.stack([area_resize(planes[:, :, i], side, side) for i in range(planes.shape[2])], axis=2)
    small = np.floor(small + 0.5).astype(samples.dtype)
    out = io.BytesIO()
    np.save(out, small[:, :, 0] if samples.ndim == 2 else small, allow_pickle=False)
    return out.getvalue()


MADE = "width int, height int, channels int, samples binary, tile binary, dhash string, error string"


def _looked_at(data: bytes | None, side: int) -> tuple:
    if data is None:
        return (None, None, None, None, None, None, "no media")
    try:
        x = decode(data)
        return (x.shape[1], x.shape[0], 1 if x.ndim == 2 else 3, x.astype(x.dtype.newbyteorder("<")).tobytes(), tile_of(x, side), difference_hash(grey_of(x)), None)
    except (ValueError, IndexError) as e:
        return (None, None, None, None, None, None, str(e) or "unreadable")


def media_columns(df: DataFrame, media: str = "media", side: int = TILE) -> DataFrame:
    """``df`` with, for each picture in the binary column ``media``: ``width``, ``height``, ``channels``, ``samples``
    (the decoded samples, row by row), ``tile`` (NPY bytes), ``dhash`` and ``error``.

    A row is handled by itself, in Arrow batches: memory is one batch, nothing is shuffled, and lost tasks are redone.
    """
    names = [x.split()[0] for x in MADE.split(", ")]
    df = drop_clashing(df, [n for n in names if n.lower() != media.lower()])

    def run(batches):
        for batch in batches:
            from_row, size, rows = 0, 0, []
            source = batch.column(batch.schema.get_field_index(media))
            for i in range(batch.num_rows):
                rows.append(_looked_at(source[i].as_py(), side))
                size += len(rows[-1][3] or b"") * 2 + 4096
                if size > BATCH_BYTES or i == batch.num_rows - 1:
                    kept = batch.slice(from_row, len(rows))
                    made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, *names])
                    from_row, size, rows = i + 1, 0, []

    return df.mapInArrow(run, f"{ddl(df)}, {MADE}")


KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]


def text_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with the UTF-8 bytes of a whole text (null: none) stored as the samples of a raw 8-bit Netpbm picture,
    64 samples a row; zeros fill the last row, and an empty text makes one row. Built by JVM functions only."""
    raw = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    size = F.octet_length(raw)
    rows = F.greatest(F.lit(1), F.ceil(size / TEXT_WIDTH)).cast("int")
    head = F.encode(F.concat(F.lit(f"P5\n{TEXT_WIDTH} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8")
    zeros = F.encode(F.repeat(F.lit("\0"), rows * TEXT_WIDTH - size), "UTF-8")
    return df.withColumn(media, F.concat(head, raw, zeros))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import spread, table, utf8

    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    stored = text_media(docs).select("doc_id", F.octet_length(utf8(F.col("text"))).cast("long").alias("n_bytes"), "media")
    seen = media_columns(stored)
    return seen.select(
        "doc_id", "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.col("dhash"), F.lit(":"), F.sha2("tile", 256).substr(1, 16)).alias("feature"),
    )
