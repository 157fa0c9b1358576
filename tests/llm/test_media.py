import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import media


def bmp(samples, bits):
    h, w, _ = samples.shape
    rows = b"".join((samples[y, :, ::-1].tobytes() if bits == 24 else np.dstack([samples[y : y + 1, :, ::-1], np.zeros((1, w, 1), np.uint8)]).tobytes()).ljust((w * bits // 8 + 3) // 4 * 4, b"\0") for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(rows), 0, 0, 0, 0) + rows


def test_decoders():
    x = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert np.array_equal(media.decode(bmp(x, 24)), x) and np.array_equal(media.decode(bmp(x, 32)), x)
    assert np.array_equal(media.decode(b"P6\n# note\n7 5 255\n" + x.tobytes()), x)
    assert np.array_equal(media.decode(b"P3 7 5 255 " + b" ".join(b"%d" % v for v in x.ravel())), x)
    g = x[:, :, 0]
    assert np.array_equal(media.decode(media.encode_pgm(g)), g)
    assert np.array_equal(media.decode(b"P2 7 5\n255\n" + b" ".join(b"%d" % v for v in g.ravel())), g)
    assert media.decode(b"P1 3 1 1 0 1").tolist() == [[0, 255, 0]] and media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 1 1 65535\n" + b"\x01\x02").tolist() == [[258]]
    palette = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + 8) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 8, 0, 0, 0, 0, 2, 0) + bytes([1, 2, 3, 0, 4, 5, 6, 0]) + bytes([1, 0, 0, 0])
    assert media.decode(palette).tolist() == [[[6, 5, 4], [3, 2, 1]]]
    head = lambda w, h, bits, packing, more, colours=0: b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(more)) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, packing, 0, 0, 0, colours, 0) + more
    colours = bytes([0, 0, 0, 0, 9, 8, 7, 0])
    assert media.decode(head(3, -1, 1, 0, colours, 2) + bytes([0b01000000, 0, 0, 0])).tolist() == [[[0, 0, 0], [7, 8, 9], [0, 0, 0]]]
    assert media.decode(head(3, -1, 4, 0, colours, 2) + bytes([0x10, 0x10, 0, 0])).tolist() == [[[7, 8, 9], [0, 0, 0], [7, 8, 9]]]
    assert media.decode(head(2, -1, 16, 0, b"") + struct.pack("<HH", 31 << 10 | 31, 31 << 5)).tolist() == [[[255, 0, 255], [0, 255, 0]]]
    assert media.decode(head(1, -1, 16, 3, struct.pack("<III", 0xF800, 0x7E0, 0x1F)) + struct.pack("<HH", 31 << 11 | 63 << 5, 0)).tolist() == [[[255, 255, 0]]]
    assert media.decode(head(1, -1, 32, 3, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)) + bytes([1, 2, 3, 9])).tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P5\n9 9\n255\nxx", b"P5 0 1 255 ", b"GIF89a", b"P2 2 1 255 1"):
        with pytest.raises((ValueError, IndexError)):
            media.decode(bad)


@pytest.mark.parametrize("shape", [(8, 9), (3, 2), (50, 64), (1, 1), (17, 31)])
def test_area_resize_against_fine_grid(shape):
    x = np.random.default_rng(1).integers(0, 256, shape).astype(float)
    for h, w in ((8, 9), (4, 4)):
        fine = np.repeat(np.repeat(x, h, axis=0), w, axis=1)
        want = fine.reshape(h, shape[0], w, shape[1]).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(x, h, w), want)


def test_query(spark, odd_docs, no_docs, saved):
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    rows = media.query(spark, saved(odd_docs, "documents")).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        stored = media.encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(stored).hexdigest()
    assert len({r.feature for r in rows if r.doc_id == 1}) == 1
    assert media.media_columns(media.text_media(no_docs)).count() == 0


def test_bad_media_and_tiles(spark):
    df = spark.createDataFrame([(1, b"P5 2 2 255 abcd"), (2, b"nope"), (3, None)], "id int, media binary")
    got = {r.id: r for r in media.media_columns(df, side=4).collect()}
    assert np.load(io.BytesIO(bytes(got[1].tile))).shape == (4, 4) and got[1].error is None and bytes(got[1].samples) == b"abcd"
    assert got[2].error and got[3].error == "no media" and got[2].tile is None


def test_clashing_columns(spark, odd_docs):
    df = media.text_media(odd_docs.select("doc_id", "text").withColumn("Width", F.lit("mine")).withColumn("dhash", F.lit(1)).withColumn("other", F.lit(2)))
    out = media.media_columns(df)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and "other" in out.columns and out.schema["width"].dataType.simpleString() == "int"
    assert out.count() == odd_docs.count()
