"""Raster files as tiles.

Files are listed by Spark's ``binaryFile`` reader and decoded on the executors. These
readers take a file as a whole; ``geotiff`` and ``arrays`` read parts of large ones.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.operators.tiles import SCHEMA, SIZE
from tiepoint.sources import geotiff, sinks

MOST_BYTES, MOST_PIXELS = 2 << 30, 150_000_000
SUFFIXES = (".png", ".tif", ".tiff")


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of a PNG's lines; ``rows`` begin with the filter's number.

    A byte depends on the one before, the one above and the one before that, so bytes of
    one slanting line are worked out at once, whichever filters their lines have.
    """
    h, w = rows.shape[0], (rows.shape[1] - 1) // step
    how, raw = rows[:, 0].astype(np.int32), rows[:, 1:].reshape(h, w, step).astype(np.int32)
    if not np.isin(how, (0, 1, 2, 3, 4)).all():
        raise ValueError("unknown PNG filter")
    if not (how > 2).any() and not (how == 2).any():  # lines do not depend on each other
        return np.where(how[:, None, None] == 1, np.cumsum(raw, axis=1) & 255, raw).astype(np.uint8).reshape(h, -1)
    out = np.zeros((h + 1, w + 1, step), np.int32)
    for t in range(h + w - 1):
        y = np.arange(max(0, t - w + 1), min(h - 1, t) + 1)
        x, kind = t - y, how[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        near = np.abs(np.stack([guess - left, guess - up, guess - corner])).argmin(axis=0)  # the first of equal ones
        paeth = np.choose(near, [left, up, corner])
        out[y + 1, x + 1] = (raw[y, x] + np.choose(kind, [0, left, up, (left + up) // 2, paeth])) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, -1)


def decode_png(raw: bytes) -> np.ndarray:
    """Height, width, bands of a non-interlaced PNG; palettes and single bits become colours, gray with alpha becomes colour with alpha.

    Gray of 2 or 4 bits is spread over 0 to 255.
    """
    at, data, palette = 8, [], None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if interlaced:
        raise ValueError("only non-interlaced PNG")
    if w * h > MOST_PIXELS:
        raise ValueError(f"more than {MOST_PIXELS} pixels")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    wide = -(-w * bands * depth // 8)
    lines = _unfiltered(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8, h * (1 + wide)).reshape(h, 1 + wide), max(1, bands * depth // 8))
    if depth < 8:
        image = (np.unpackbits(lines, axis=1)[:, : w * depth].reshape(h, w, depth) @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :, None]
        image = image if colour == 3 else image * np.uint8(255 // ((1 << depth) - 1))
    else:
        image = (lines.view(">u2").astype(np.uint16) if depth == 16 else lines).reshape(h, w, bands)
    if colour == 3:
        return palette[image[:, :, 0]]
    if depth == 1:
        return image[:, :, [0, 0, 0]]
    return image[:, :, [0, 0, 0, 1]] if colour == 4 else image


def decode_tiff(raw: bytes) -> np.ndarray:
    """Height, width, bands of a TIFF file that is here as a whole."""
    f = io.BytesIO(raw)
    layout = geotiff.layout_of(geotiff.directory(f))
    out = None
    for nth in range(-(-layout["width"] // layout["block_w"]) * -(-layout["height"] // layout["block_h"])):
        y, x, block = geotiff.read_block(f, layout, nth)
        out = np.zeros((layout["height"], layout["width"], layout["bands"]), block.dtype) if out is None else out
        out[y : y + block.shape[0], x : x + block.shape[1]] = block
    return out.astype(out.dtype.newbyteorder("="))


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit gray or colour image as PNG."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(h, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def encode_tiff(image: np.ndarray) -> bytes:
    """An image of any numeric type as uncompressed TIFF."""
    return geotiff.encode(image, geotiff.NONE, tile=None, rows=image.shape[0])


def gray_of(image: np.ndarray) -> np.ndarray:
    """One plane of an image: its only one, or colours by the usual weights, rounded down; alpha is left out."""
    if image.shape[2] < 3:
        return image[:, :, 0]
    r, g, b = (image[:, :, i].astype(np.int64) for i in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16


def decode(path: str, raw: bytes) -> np.ndarray:
    return decode_png(raw) if path.lower().endswith(".png") else decode_tiff(raw)


def read_tiles(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """Tiles of all PNG and TIFF files of a folder or glob, and a ``problem`` for files that cannot be read.

    ``product_id`` is the path. Files over the size limit are not opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,tif,tiff,PNG,TIF,TIFF}").load(path)
    files = files.select("path", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content"))
    types = [pa.string(), *[pa.int32()] * 5, pa.binary(), pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["problem"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if content is None:
                        raise ValueError(f"more than {MOST_BYTES} bytes")
                    image = decode(name, content)
                except Exception as e:  # any broken file is a row, not a failed job
                    rows = [(name, 0, 0, 0, 0, 0, b"", str(e))]
                else:
                    h, w, bands = image.shape
                    rows = [(name, b, ty, tx, h, w, np.ascontiguousarray(image[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size, b], np.float32).tobytes(), None) for b in range(bands) for ty in range(-(-h // size)) for tx in range(-(-w // size))]
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64], strict=True), types, strict=True)], names)

    return files.mapInArrow(run, SCHEMA + ", problem string")


def whole_images(tiles: DataFrame, kind: str = "png", size: int = SIZE, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """``product_id, band, content``: each plane as one PNG (8 bits) or TIFF file (32-bit floats).

    An image file is whole by nature; planes over ``most_pixels`` raise an error and stay tiles.
    """

    def assemble(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        h, w = rows[0]["full_h"], rows[0]["full_w"]
        if h * w > most_pixels:
            raise ValueError(f"more than {most_pixels} pixels")
        out = np.zeros((h, w), np.float32)
        for r in rows:
            part = np.frombuffer(r["pixels"], np.float32).reshape(-1, min(size, w - r["tx"] * size))
            out[r["ty"] * size : r["ty"] * size + len(part), r["tx"] * size : r["tx"] * size + part.shape[1]] = part
        content = encode_png(np.clip(out, 0, 255).astype(np.uint8)) if kind == "png" else encode_tiff(out)
        return pa.table({"product_id": table.column("product_id").slice(0, 1), "band": table.column("band").slice(0, 1), "content": pa.array([content], pa.binary())})

    return tiles.groupBy("product_id", "band").applyInArrow(assemble, "product_id string, band int, content binary")


def write_files(files: DataFrame, folder: str, suffix: str) -> None:
    """Each row's content as a file ``<product>_<band><suffix>`` of a folder of any store, all of them or none; see ``sinks.write``."""
    sinks.write(files.select(F.concat_ws("_", F.col("product_id").cast("string"), F.col("band").cast("string")).alias("name"), "content"), folder, suffix)
