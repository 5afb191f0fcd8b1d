"""TIFF and GeoTIFF files by blocks.

Spark lists the files; tasks read the tag directories alone, prune strips or tiles that
a window does not need, and hand out the rest in ranges, so that one large file is
read by many tasks and no file is whole in one. Strips and tiles, either byte order,
32- and 64-bit offsets, chunky and planar bands, whole and floating samples of 1 to 64 bits,
LZW, Deflate and PackBits, horizontal and floating predictors, geo keys, nodata, alpha.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.sources.store import opened

MOST_BYTES, MOST_PIXELS = 2 << 30, 150_000_000
#: Decoded bytes of the blocks that a row hands to a task.
TASK_BYTES = 8 << 20
# Fixed values of the format: field types by number, compressions, and tags.
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _BANDS, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_W, _TILE_H, _TILE_OFFSETS, _TILE_COUNTS, _EXTRA, _FORMAT = 322, 323, 324, 325, 338, 339
_SCALE, _TIE, _MATRIX, _KEYS, _DOUBLES, _ASCII, _METADATA, _NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42112, 42113
_MODEL, _RASTER, _CITATION, _GEOGRAPHIC, _PROJECTED, _UNIT = 1024, 1025, 1026, 2048, 3072, 3076
_METRE, _DEFINED_ELSEWHERE = 9001, 32767

HEADER = (
    "product_id string, width int, height int, bands int, dtype string, crs string, projected boolean, transform array<double>, nodata double, tags map<string,string>, pixel_scale double, problem string, layout string"
)
PIXELS = "product_id string, band int, y int, x int, v double, valid boolean"


def directory(f) -> dict[int, tuple]:
    """The tags of a file's first image."""
    head = f.read_at(16, 0) if hasattr(f, "read_at") else (f.seek(0), f.read(16))[1]

    def at(offset: int, size: int) -> bytes:
        f.seek(offset)
        got = f.read(size)
        if len(got) != size:
            raise ValueError("the file ends within its directory")
        return got

    if head[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF file")
    order = "<" if head[:2] == b"II" else ">"
    (magic,) = struct.unpack(order + "H", head[2:4])
    if magic == 42:
        (start,), count, entry, offset = struct.unpack(order + "I", head[4:8]), "H", 12, "I"
    elif magic == 43:
        (start,), count, entry, offset = struct.unpack(order + "Q", head[8:16]), "Q", 20, "Q"
    else:
        raise ValueError("no TIFF file")
    n_size, size = struct.calcsize(count), struct.calcsize(offset)
    (n,) = struct.unpack(order + count, at(start, n_size))
    body = at(start + n_size, n * entry)
    tags: dict[int, tuple] = {0: (order,)}
    for i in range(n):
        field = body[i * entry : (i + 1) * entry]
        tag, kind, many = struct.unpack(order + "HH" + offset, field[: 4 + size])
        if kind not in _KINDS:
            continue
        letters = _KINDS[kind]
        form = f"{order}{many}s" if letters == "s" else order + letters * many if len(letters) > 1 else f"{order}{many}{letters}"
        length = struct.calcsize(form)
        where = field[4 + size : 4 + size + length] if length <= size else at(struct.unpack(order + offset, field[4 + size :])[0], length)
        tags[tag] = struct.unpack(form, where)
    return tags


def geography(tags: dict[int, tuple]) -> dict:
    """CRS, transform (a, b, c, d, e, f: x = a col + b row + c, y = d col + e row + f), nodata and named tags."""
    keys, doubles, ascii_ = tags.get(_KEYS, ()), tags.get(_DOUBLES, ()), tags.get(_ASCII, (b"",))[0].decode("latin-1")
    found: dict[int, object] = {}
    for i in range(4, len(keys) - 3, 4):
        key, where, many, value = keys[i : i + 4]
        found[key] = value if where == 0 else ascii_[value : value + many].rstrip("|\0") if where == _ASCII else doubles[value] if where == _DOUBLES and value < len(doubles) else None
    projected = found.get(_MODEL) == 1
    code = found.get(_PROJECTED if projected else _GEOGRAPHIC)
    crs = f"EPSG:{code}" if isinstance(code, int) and 0 < code < _DEFINED_ELSEWHERE else found.get(_CITATION) or None
    transform = None
    if len(tags.get(_MATRIX, ())) == 16:
        m = tags[_MATRIX]
        transform = [m[0], m[1], m[3], m[4], m[5], m[7]]
    elif len(tags.get(_SCALE, ())) >= 2 and len(tags.get(_TIE, ())) >= 6:
        (sx, sy), (col, row, _, x, y, _) = tags[_SCALE][:2], tags[_TIE][:6]
        transform = [sx, 0.0, x - col * sx, 0.0, -sy, y + row * sy]
    if transform and found.get(_RASTER) == 2:  # the tie names a pixel's middle
        a, b, c, d, e, f = transform
        transform = [a, b, c - (a + b) / 2, d, e, f - (d + e) / 2]
    text = tags.get(_NODATA, (b"",))[0].split(b"\0")[0].strip().decode("latin-1")
    nodata = None
    if text:
        try:
            nodata = float(text)
        except ValueError:
            pass
    named = {}
    xml = tags.get(_METADATA, (b"",))[0].split(b"\0")[0]
    if xml:
        for item in ElementTree.fromstring(xml).iter("Item"):
            if item.get("sample") is None and item.get("domain") is None:
                named[item.get("name")] = item.text or ""
    return {"crs": crs, "projected": bool(crs and projected), "metres": found.get(_UNIT, _METRE) == _METRE, "transform": transform, "nodata": nodata, "tags": named}


def pixel_scale(transform: list[float] | None, metric: bool) -> float | None:
    """Metres of a pixel where the grid is projected in metres and its two sides agree within 1 %."""
    if not transform or not metric:
        return None
    across, down = math.hypot(transform[0], transform[3]), math.hypot(transform[1], transform[4])
    return (across + down) / 2 if across > 0 and abs(across - down) / across < 0.01 else None


def layout_of(tags: dict[int, tuple]) -> dict:
    """Where the samples are: everything that reading a block needs."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bands = one(_WIDTH, 0), one(_HEIGHT, 0), one(_BANDS, 1)
    bits, kind = set(tags.get(_BITS, (1,))), set(tags.get(_FORMAT, (1,)))
    if min(width, height, bands) < 1:
        raise ValueError("an image without pixels")
    if width * height > MOST_PIXELS:
        raise ValueError(f"more than {MOST_PIXELS} pixels")
    if len(bits) != 1 or len(kind) != 1:
        raise ValueError("bands of different types")
    (bits,), (kind,) = bits, kind
    letter = {1: "u", 2: "i", 3: "f"}.get(kind)
    if letter is None or bits not in {"u": (1, 2, 4, 8, 16, 32, 64), "i": (8, 16, 32, 64), "f": (16, 32, 64)}[letter]:
        raise ValueError(f"unsupported samples: {bits} bits of format {kind}")
    if one(_COMPRESSION, 1) not in (NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS):
        raise ValueError(f"unsupported compression: {one(_COMPRESSION, 1)}")
    if one(_PREDICTOR, 1) not in (1, 2, 3) or (one(_PREDICTOR, 1) == 3) > (letter == "f") or (one(_PREDICTOR, 1) == 2 and bits < 8):
        raise ValueError(f"unsupported predictor: {one(_PREDICTOR, 1)}")
    tiled = _TILE_W in tags
    w, h = (one(_TILE_W, 0), one(_TILE_H, 0)) if tiled else (width, min(one(_ROWS, height), height))
    offsets, counts = (tags.get(_TILE_OFFSETS), tags.get(_TILE_COUNTS)) if tiled else (tags.get(_OFFSETS), tags.get(_COUNTS))
    planes = bands if one(_PLANAR, 1) == 2 else 1
    if min(w, h) < 1 or not offsets or not counts or min(len(offsets), len(counts)) < -(-width // w) * -(-height // h) * planes:
        raise ValueError("the directory lacks blocks")
    return {
        "order": tags[0][0], "width": width, "height": height, "bands": bands, "bits": bits, "letter": letter, "compression": one(_COMPRESSION, 1), "predictor": one(_PREDICTOR, 1), "planar": planes > 1, "tiled": tiled,
        "block_w": w, "block_h": h, "offsets": list(offsets), "counts": list(counts), "alpha": bands > 1 and tags.get(_EXTRA, (0,))[-1] in (1, 2),
    }


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; they get wider one code early."""
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, acc, bits, width, before = fresh.copy(), [], 0, 0, 9, None
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 256:
            table, width, before = fresh.copy(), 9, None
        elif code == 257:
            break
        elif before is None:
            before = table[code]
            out.append(before)
        else:
            if code > len(table):
                raise ValueError("broken LZW data")
            now = table[code] if code < len(table) else before + before[:1]
            table.append(before + now[:1])
            out.append(now)
            before = now
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, acc, bits = bytearray(), 0, 0
    table, free, width = {bytes([i]): i for i in range(256)}, 258, 9

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits)
            acc &= (1 << bits) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer], free, word = free, free + 1, data[i : i + 1]
        if free == 4094:
            put(256)
            table, free, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif free > (1 << width) - 1:
            width += 1
    if word:
        put(table[word])
        free += 1
        if free > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(acc << (8 - bits))
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 1 if n == 128 else 2
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out = bytearray()
    for run in re.finditer(rb"(?s)(.)\1{2,127}|(?:(.)(?!\2\2)){1,128}", data):
        got = run.group()
        out += bytes([257 - len(got)]) + got[:1] if run.group(1) is not None else bytes([len(got) - 1]) + got
    return bytes(out)


def decoded(raw: bytes, layout: dict, rows: int) -> np.ndarray:
    """A block's rows, columns and bands."""
    how = layout["compression"]
    data = zlib.decompress(raw) if how in (DEFLATE, DEFLATE_OLD) else unpack_lzw(raw) if how == LZW else unpack_bits(raw) if how == PACKBITS else raw
    w, bands, bits = layout["block_w"], 1 if layout["planar"] else layout["bands"], layout["bits"]
    wide = -(-w * bands * bits // 8)
    if len(data) < rows * wide:
        raise ValueError("a block is shorter than its rows")
    lines = np.frombuffer(data, np.uint8, rows * wide).reshape(rows, wide)
    if bits < 8:
        each = np.unpackbits(lines, axis=1)[:, : w * bands * bits].reshape(rows, w * bands, bits)
        return (each @ (1 << np.arange(bits)[::-1])).astype(np.uint8).reshape(rows, w, bands)
    size = bits // 8
    if layout["predictor"] == 3:
        # bytes of a row by significance, each the sum of those one pixel before
        sums = np.cumsum(lines.reshape(rows, -1, bands), axis=1, dtype=np.uint8).reshape(rows, size, w * bands)
        return np.ascontiguousarray(sums.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, w, bands)
    kind = np.dtype(f"{layout['order']}{layout['letter']}{size}")
    values = lines.view(kind).reshape(rows, w, bands)
    if layout["predictor"] == 2:
        whole = values.view(f"{layout['order']}u{size}").astype(f"u{size}")
        values = np.cumsum(whole, axis=1, dtype=whole.dtype).view(kind.newbyteorder("="))
    return values


def read_block(f, layout: dict, nth: int) -> tuple[int, int, np.ndarray]:
    """First row and column of the ``nth`` place of the grid of blocks, and its pixels of all bands, without what lies beyond the image."""
    w, h = layout["block_w"], layout["block_h"]
    across, down = -(-layout["width"] // w), -(-layout["height"] // h)
    y, x = nth // across * h, nth % across * w
    rows = h if layout["tiled"] else min(h, layout["height"] - y)
    parts = []
    for plane in range(layout["bands"] if layout["planar"] else 1):
        at = nth + plane * across * down
        f.seek(layout["offsets"][at])
        parts.append(decoded(f.read(layout["counts"][at]), layout, rows))
    return y, x, np.concatenate(parts, axis=2)[: layout["height"] - y, : layout["width"] - x]


def read_header(name: str, f) -> dict:
    import json

    tags = directory(f)
    layout, geo = layout_of(tags), geography(tags)
    layout["nodata"] = geo["nodata"]
    return {
        "product_id": name, **{k: layout[k] for k in ("width", "height", "bands")}, "dtype": f"{layout['letter']}{layout['bits']}", **{k: geo[k] for k in ("crs", "projected", "transform", "nodata")}, "tags": list(geo["tags"].items()),
        "pixel_scale": pixel_scale(geo["transform"], geo["projected"] and geo["metres"]), "problem": None, "layout": json.dumps(layout),
    }


_HEADER_ARROW = pa.schema([
    ("product_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bands", pa.int32()), ("dtype", pa.string()), ("crs", pa.string()), ("projected", pa.bool_()), ("transform", pa.list_(pa.float64())), ("nodata", pa.float64()),
    ("tags", pa.map_(pa.string(), pa.string())), ("pixel_scale", pa.float64()), ("problem", pa.string()), ("layout", pa.string()),
])


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each TIFF file of a folder or glob: size, type, CRS, transform, nodata, tags, metres of a pixel, and a ``problem`` for files that cannot be read.

    Only directories are read; Spark does not list empty files. A file that is too large, broken or of a kind that is not
    supported has a problem and nulls.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if length > MOST_BYTES:
                        raise ValueError(f"more than {MOST_BYTES} bytes")
                    with opened(name) as f:
                        rows.append(read_header(name, f))
                except Exception as e:  # any broken file is a row, not a failed job
                    rows.append({"product_id": name, "problem": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, _HEADER_ARROW)

    return files.mapInArrow(run, HEADER)


def pixels(found: DataFrame, window: tuple[int, int, int, int] | None = None, bands: Sequence[int] | None = None) -> DataFrame:
    """``product_id, band, y, x, v, valid`` of files in ``headers``, in the coordinates of ``window`` (x, y, width, height).

    Blocks outside the window are not read. A pixel is valid where no band of it is
    nodata or not finite and its alpha, if there is one, is not 0; nodata values are 0. Files
    with a problem have no pixels; a window that leaves the image is an error.
    """
    import json

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                layout = json.loads(text)
                x, y, w, h = window or (0, 0, layout["width"], layout["height"])
                if min(x, y) < 0 or min(w, h) < 1 or x + w > layout["width"] or y + h > layout["height"]:
                    raise ValueError(f"the window lies outside the image {name}")
                across = -(-layout["width"] // layout["block_w"])
                down = -(-layout["height"] // layout["block_h"])
                wanted = [r * across + c for r in range(y // layout["block_h"], (y + h - 1) // layout["block_h"] + 1) for c in range(x // layout["block_w"], (x + w - 1) // layout["block_w"] + 1)]
                size = layout["block_w"] * layout["block_h"] * layout["bands"] * max(1, layout["bits"] // 8)
                step = max(1, TASK_BYTES // size)
                rest = {k: v for k, v in layout.items() if k not in ("offsets", "counts")}
                rows = []
                for i in range(0, len(wanted), step):
                    some = wanted[i : i + step]
                    at = [n + p * across * down for n in some for p in range(layout["bands"] if layout["planar"] else 1)]
                    rows.append((name, json.dumps(rest), some, [layout["offsets"][k] for k in at], [layout["counts"][k] for k in at]))
                kinds = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["product_id", "layout", "blocks", "offsets", "counts"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                layout = json.loads(r["layout"])
                x0, y0, w, h = window or (0, 0, layout["width"], layout["height"])
                across, down = -(-layout["width"] // layout["block_w"]), -(-layout["height"] // layout["block_h"])
                planes = layout["bands"] if layout["planar"] else 1
                with opened(r["product_id"]) as f:
                    for i, nth in enumerate(r["blocks"]):
                        for p in range(planes):  # the places of this block alone
                            layout.setdefault("offsets", {})[nth + p * across * down] = r["offsets"][i * planes + p]
                            layout.setdefault("counts", {})[nth + p * across * down] = r["counts"][i * planes + p]
                        y, x, block = read_block(f, layout, nth)
                        top, left = max(y0 - y, 0), max(x0 - x, 0)
                        block = block[top : y0 + h - y, left : x0 + w - x]
                        yield from rows_of(r["product_id"], block, y + top - y0, x + left - x0, layout, bands)

    handed = found.where("problem is null").select("product_id", "layout").mapInArrow(hand_out, "product_id string, layout string, blocks array<int>, offsets array<bigint>, counts array<bigint>")
    return handed.repartition("product_id", "blocks").mapInArrow(read, PIXELS)


def rows_of(name: str, block: np.ndarray, y: int, x: int, layout: dict, bands: Sequence[int] | None) -> Iterator[pa.RecordBatch]:
    """A batch for each band of a block."""
    nodata, color = layout.get("nodata"), block[:, :, :-1] if layout["alpha"] else block
    lost = np.isnan(color) if nodata is not None and math.isnan(nodata) and color.dtype.kind == "f" else color == nodata if nodata is not None else np.zeros(color.shape, bool)
    valid = ~lost.any(axis=2)
    if block.dtype.kind == "f":
        valid &= np.isfinite(block).all(axis=2)
    if layout["alpha"]:
        valid &= block[:, :, -1] != 0
    h, w, n = block.shape
    ys, xs = np.repeat(np.arange(y, y + h, dtype=np.int32), w), np.tile(np.arange(x, x + w, dtype=np.int32), h)
    for b in range(n) if bands is None else bands:
        if not 0 <= b < n:
            raise ValueError(f"no band {b} in {name}")
        v = block[:, :, b].astype(np.float64)
        if b < lost.shape[2]:
            v = np.where(lost[:, :, b], 0.0, v)
        names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(h * w, np.int32)), pa.array([name])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array(np.full(h * w, b, np.int32)), pa.array(ys), pa.array(xs), pa.array(v.ravel()), pa.array(valid.ravel())], ["product_id", "band", "y", "x", "v", "valid"])


def read(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, bands: Sequence[int] | None = None) -> DataFrame:
    """Pixels of all readable TIFF files of a folder or glob."""
    return pixels(headers(spark, path), window, bands)


def scale_ratio(source: Column, reference: Column) -> Column:
    """Pixels of the source for one of the reference, where both have a scale."""
    return F.when(reference > 0, source / reference)


def encode(
    image: np.ndarray, compression: int = DEFLATE, predictor: int = 1, tile: int | None = 256, rows: int = 64, planar: bool = False, order: str = "<", big: bool = False,
    transform: Sequence[float] | None = None, epsg: int | None = None, projected: bool = True, nodata: float | None = None, tags: dict[str, str] | None = None, alpha: bool = False,
) -> bytes:
    """An image of rows, columns and perhaps bands as a TIFF file, with its place on the ground if that is known."""
    image = image[:, :, None] if image.ndim == 2 else image
    h, w, bands = image.shape
    kind = image.dtype.newbyteorder(order)
    size = kind.itemsize
    bw, bh = (tile, tile) if tile else (w, min(rows, h))
    pack = {NONE: bytes, LZW: pack_lzw, DEFLATE: zlib.compress, DEFLATE_OLD: zlib.compress, PACKBITS: pack_bits}[compression]
    blocks = []
    for plane in ([image[:, :, b : b + 1] for b in range(bands)] if planar else [image]):
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                part = plane[y : y + bh, x : x + bw]
                if tile:
                    part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1]), (0, 0)))
                n, m, k = part.shape
                if predictor == 2:
                    whole = np.ascontiguousarray(part).view(f"u{size}")
                    part = np.concatenate([whole[:, :1], whole[:, 1:] - whole[:, :-1]], axis=1).astype(f"{order}u{size}")
                elif predictor == 3:
                    by = np.ascontiguousarray(part.astype(f">f{size}")).view(np.uint8).reshape(n, m * k, size).transpose(0, 2, 1).reshape(n, -1, k)
                    part = np.concatenate([by[:, :1], by[:, 1:] - by[:, :-1]], axis=1)
                else:
                    part = part.astype(kind)
                blocks.append(pack(np.ascontiguousarray(part).tobytes()))
    entry, long_, head = (20, "Q", 16) if big else (12, "I", 8)
    place = head
    offsets = []
    for b in blocks:
        offsets.append(place)
        place += len(b)
    fields = [(_WIDTH, 4, [w]), (_HEIGHT, 4, [h]), (_BITS, 3, [size * 8] * bands), (_COMPRESSION, 3, [compression]), (262, 3, [1]), (_BANDS, 3, [bands]), (_PLANAR, 3, [2 if planar else 1]), (_PREDICTOR, 3, [predictor]), (_FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands)]
    where = (16 if big else 4)
    fields += [(_TILE_W, 4, [bw]), (_TILE_H, 4, [bh]), (_TILE_OFFSETS, where, offsets), (_TILE_COUNTS, where, [len(b) for b in blocks])] if tile else [(_ROWS, 4, [bh]), (_OFFSETS, where, offsets), (_COUNTS, where, [len(b) for b in blocks])]
    if alpha:
        fields.append((_EXTRA, 3, [0] * (bands - 2) + [2]))
    if transform is not None:
        a, b, c, d, e, f = transform
        fields += [(_SCALE, 12, [a, -e, 0.0]), (_TIE, 12, [0.0, 0.0, 0.0, c, f, 0.0])] if b == d == 0 and a > 0 > e else [(_MATRIX, 12, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    if epsg is not None:
        keys = [(_MODEL, 1 if projected else 2), (_RASTER, 1), (_PROJECTED if projected else _GEOGRAPHIC, epsg)] + [(_UNIT, _METRE)] * projected
        fields.append((_KEYS, 3, [1, 1, 0, len(keys), *(v for k, x in keys for v in (k, 0, 1, x))]))
    if nodata is not None:
        fields.append((_NODATA, 2, repr(float(nodata)).encode() + b"\0"))
    if tags:
        root = ElementTree.Element("GDALMetadata")
        for k, v in tags.items():
            ElementTree.SubElement(root, "Item", name=k).text = v
        fields.append((_METADATA, 2, ElementTree.tostring(root) + b"\0"))
    fields.sort()
    pad = place % 2
    start = place + pad
    extra_at = start + (8 if big else 2) + entry * len(fields) + (8 if big else 4)
    body, extra = b"", b""
    for tag, code, values in fields:
        data = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{_KINDS[code]}", *values)
        inline = len(data) <= struct.calcsize(long_)
        cell = data.ljust(struct.calcsize(long_), b"\0") if inline else struct.pack(order + long_, extra_at + len(extra))
        if not inline:
            extra += data + bytes(len(data) % 2)
        body += struct.pack(order + "HH" + long_, tag, code, len(values)) + cell
    first = {"<": b"II", ">": b"MM"}[order]
    header = first + (struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start))
    return header + b"".join(blocks) + bytes(pad) + struct.pack(order + ("Q" if big else "H"), len(fields)) + body + bytes(8 if big else 4) + extra
