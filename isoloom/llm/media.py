"""Media columns: Netpbm and BMP images as binary columns, decoded to numpy, resized by area, with tiles and difference hashes.

Formats: PBM, PGM and PPM in plain (P1 to P3) and raw form (P4 to P6) with samples of 8 or 16
bits, and uncompressed BMP with 8, 24 or 32 bits a pixel. A row's image gives an NPY tile (the
area-resized grey picture as the bytes of a .npy file) and a 64-bit difference hash.

Defined results: a null image or one of another or broken format gives null features and the
`error` column says why; an image of any height is resized strip by strip, in memory bounded by
the strip; equal images get equal features; an empty table gives no rows. Texts stored as images:
a null or empty text is one block of padding.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.runtime import prepare

#: A text's payload is padded with PAD to a positive multiple of BLOCK, as rows of WIDTH samples.
BLOCK, PAD, WIDTH = 576, 255, 24
TILE = 16
STRIP_ROWS = 4096


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 0
    kind = data[:2]
    need = 3 if kind in (b"P1", b"P4") else 4
    while len(fields) < need:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("header ends early")
        fields.append(data[at:end])
        at = end
    width, height = int(fields[1]), int(fields[2])
    most = int(fields[3]) if need == 4 else 1
    planes = 3 if kind in (b"P3", b"P6") else 1
    if not (width > 0 and height > 0 and 0 < most < 65536):
        raise ValueError("impossible header")
    if kind in (b"P1", b"P2", b"P3"):
        body = data[at:]
        values = np.array(list(body.translate(None, b" \t\r\n")), np.int64) - 48 if kind == b"P1" else np.array(body.split(), np.int64)
    elif kind == b"P4":
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, stride * height, at + 1)
        values = np.unpackbits(raw.reshape(height, stride), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, width * height * planes, at + 1)
    if len(values) < width * height * planes:
        raise ValueError("samples are missing")
    values = values[: width * height * planes]
    if need == 3:
        return ((1 - values) * 255).astype(np.uint8).reshape(height, width)
    if most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    values = values.astype(np.uint8)
    return values.reshape(height, width, 3) if planes == 3 else values.reshape(height, width)


def _bmp(data: bytes) -> np.ndarray:
    start, size, width, height = struct.unpack_from("<IIii", data, 10)
    bits, packing = struct.unpack_from("<HI", data, 28)
    if packing not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("a kind of BMP that is not read")
    rows, stride = abs(height), (width * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    raw = raw[::-1] if height > 0 else raw
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(used, 4)
        rgb = palette[raw[:, :width]][:, :, 2::-1]
        return rgb[:, :, 0] if (palette[:, :1] == palette[:, :3]).all() else rgb
    return raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """An image file's samples: (height, width) or (height, width, 3), 8 bits each."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, rows from the top."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    start = 54 + 1024
    return b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, -height, 1, 8, 0, rows.size, 0, 0, 256, 0) + palette.tobytes() + rows.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    weights = np.array([299, 587, 114], np.int64)
    return ((image.astype(np.int64) * weights).sum(axis=2) // 1000).astype(np.uint8)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean brightness of each cell of a height x width grid, from integral images of strips of rows.

    The integral image is bilinear between its knots, so cells with fractional edges are exact.
    """
    rows, cols = image.shape
    cuts = np.arange(height + 1) * rows / height
    low = np.minimum(cuts.astype(np.int64), rows - 1)
    lines = np.zeros((height + 1, cols + 1))
    carry = np.zeros(cols + 1)
    for top in range(0, rows, STRIP_ROWS):
        strip = image[top : top + STRIP_ROWS]
        integral = np.zeros((len(strip) + 1, cols + 1))
        np.cumsum(np.cumsum(strip, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])
        integral += carry
        here = np.flatnonzero((low >= top) & (low < top + len(strip)))
        below = low[here] - top
        part = (cuts[here] - low[here])[:, None]
        lines[here] = integral[below] * (1 - part) + integral[below + 1] * part
        carry = integral[-1]
    at = np.arange(width + 1) * cols / width
    left = np.minimum(at.astype(np.int64), cols - 1)
    part = at - left
    corners = lines[:, left] * (1 - part) + lines[:, left + 1] * part
    area = (rows / height) * (cols / width)
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) / area


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hexadecimal: is a cell of the 8 x 9 grid darker than its right neighbour."""
    cells = np.round(resize(image, 8, 9), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.round(resize(image, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def text_image(text: bytes) -> bytes:
    """A text's UTF-8 bytes as a PGM picture."""
    size = max(1, -(-len(text) // BLOCK)) * BLOCK
    return encode_pgm(np.frombuffer(text.ljust(size, bytes([PAD])), np.uint8).reshape(-1, WIDTH))


def _mapped(df: DataFrame, make, columns: list[tuple[str, pa.DataType, str]], keep: tuple[str, ...], source) -> DataFrame:
    """Columns `keep`, then those `make` gives for each value of `source`."""
    prepare(df.sparkSession)
    names = list(keep)
    added = [c[0] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(x.as_py()) for x in batch.column("_source")]
            arrays = [pa.array([m[i] for m in made], c[1]) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], names=[*names, *added])

    schema = ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names), *(f"`{c[0]}` {c[2]}" for c in columns)])
    return df.select(*names, source.alias("_source")).mapInArrow(run, schema)


def text_media(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each text stored as an image: columns `keep`, media (PGM bytes), n_bytes."""

    def make(data: bytes | None):
        data = data or b""
        return text_image(data), len(data)

    return _mapped(docs, make, [("media", pa.binary(), "binary"), ("n_bytes", pa.int64(), "long")], keep, F.col("text").cast("binary"))


def features(images: DataFrame, keep: tuple[str, ...] = ("doc_id",), column: str = "media") -> DataFrame:
    """Each image decoded: columns `keep`, height, width, tile (NPY bytes), feature (difference hash), error."""

    def make(data: bytes | None):
        if data is None:
            return None, None, None, None, "no image"
        try:
            image = grey(decode(data))
        except (ValueError, struct.error, IndexError) as e:
            return None, None, None, None, str(e)
        return image.shape[0], image.shape[1], npy_tile(image), difference_hash(image), None

    kinds = [("height", pa.int64(), "long"), ("width", pa.int64(), "long"), ("tile", pa.binary(), "binary"), ("feature", pa.string(), "string"), ("error", pa.string(), "string")]
    return _mapped(images, make, kinds, keep, F.col(column))


def digests(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each text stored as an image and read back, in one pass: sizes and digests of payload and stored form, and the hash."""

    def make(data: bytes | None):
        data = data or b""
        stored = text_image(data)
        image = decode(stored)
        payload = image.tobytes()
        return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), zlib.crc32(npy_tile(image)))

    kinds = [("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"), ("tile_crc32", pa.int64(), "long")]
    return _mapped(docs, make, kinds, keep, F.col("text").cast("binary"))
