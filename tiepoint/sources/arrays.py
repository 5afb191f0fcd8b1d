"""Labelled arrays and cubes: an XML label and a raw binary beside it, in any order of axes.

A label is parsed into one layout: the file, the element type, the axes from slowest to
fastest, special constants, scaling. Ranges of lines of all labels are then dealt to
tasks. What is read of a range is, for every index of the axes slower than the lines, one
stretch of the file; bands that are not asked for are skipped where they are slower.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from itertools import product
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.sources.store import opened, place

MOST_PIXELS = 150_000_000
#: Values that a task holds at once.
BLOCK = 1 << 20
PIXELS = "product_id string, band int, y int, x int, v double, valid boolean"
#: Element types of labelled arrays.
ELEMENTS = {
    "UnsignedByte": "u1", "SignedByte": "i1", "UnsignedLSB2": "<u2", "UnsignedMSB2": ">u2", "SignedLSB2": "<i2", "SignedMSB2": ">i2", "UnsignedLSB4": "<u4", "UnsignedMSB4": ">u4", "SignedLSB4": "<i4", "SignedMSB4": ">i4",
    "IEEE754LSBSingle": "<f4", "IEEE754MSBSingle": ">f4", "IEEE754LSBDouble": "<f8", "IEEE754MSBDouble": ">f8",
}
_AXES = {"line": "lines", "sample": "samples", "band": "bands"}


@dataclass(frozen=True)
class Layout:
    """Where the numbers of one array are. ``axes`` goes from the slowest to the fastest."""

    file: str
    offset: int
    element: str
    axes: list[str]
    sizes: list[int]
    special: list[str]
    factor: float
    shift: float

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.element)

    def size(self, axis: str) -> int:
        return self.sizes[self.axes.index(axis)] if axis in self.axes else 1

    def stretches(self, first: int, last: int, bands: Sequence[int] | None) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """For every index of the axes slower than lines: it, and the first element and the number of elements of the lines."""
        at = self.axes.index("line")
        inner = math.prod(self.sizes[at + 1 :])
        wanted = [bands if a == "band" and bands is not None else range(n) for a, n in zip(self.axes[:at], self.sizes[:at], strict=True)]
        for outer in product(*wanted):
            row = 0
            for i, n in zip(outer, self.sizes[:at], strict=True):
                row = row * n + i
            yield outer, (row * self.sizes[at] + first) * inner, (last - first) * inner

    def read(self, f, first: int, last: int, bands: Sequence[int] | None = None) -> np.ndarray:
        """Lines, samples and bands (all, or those given, in their order)."""
        at, kind = self.axes.index("line"), self.dtype
        parts = []
        for _, start, many in self.stretches(first, last, bands):
            f.seek(self.offset + start * kind.itemsize)
            raw = f.read(many * kind.itemsize)
            if len(raw) != many * kind.itemsize:
                raise ValueError("the binary is shorter than its label says")
            parts.append(np.frombuffer(raw, kind))
        early = "band" in self.axes[:at]
        shape = [len(bands) if a == "band" and early and bands is not None else n for a, n in zip(self.axes, self.sizes, strict=True)]
        shape[at] = last - first
        cube = np.concatenate(parts).reshape(shape)
        cube = cube.reshape(*shape, 1) if "band" not in self.axes else cube
        names = [*self.axes, "band"] if "band" not in self.axes else self.axes
        cube = cube.transpose([names.index(a) for a in ("line", "sample", "band")])
        return cube if bands is None or early else cube[:, :, list(bands)]

    def good(self, v: np.ndarray) -> np.ndarray:
        """Whether numbers are finite and no special constants of the label."""
        ok = np.isfinite(v) if v.dtype.kind == "f" else np.ones(v.shape, bool)
        for text in self.special:
            try:
                number = np.array(text, dtype=v.dtype) if v.dtype.kind == "f" else int(text)
            except (ValueError, OverflowError):
                continue  # a constant that no element of this type can have
            ok &= v != number
        return ok


def _named(element, name: str) -> list:
    return [c for c in element if c.tag.rsplit("}", 1)[-1] == name]


def _value(element, *path: str) -> str:
    for name in path:
        found = _named(element, name) if element is not None else []
        element = found[0] if found else None
    return (element.text or "").strip() if element is not None else ""


def layout_of(label: str) -> Layout:
    """The first numeric array with lines and samples, and perhaps bands, of a label's text."""
    why = "the label has no image array"
    for area in ElementTree.fromstring(label).iter():
        if not area.tag.rsplit("}", 1)[-1].startswith("File_Area"):
            continue
        for array in area:
            axes = _named(array, "Axis_Array")
            if not array.tag.rsplit("}", 1)[-1].startswith("Array_") or len(axes) not in (2, 3):
                continue
            order = sorted((int(_value(a, "sequence_number")), _value(a, "axis_name").lower(), int(_value(a, "elements"))) for a in axes)
            names, sizes = [n for _, n, _ in order], [n for *_, n in order]
            element = _value(array, "Element_Array", "data_type")
            constants = [c.text.strip() for s in _named(array, "Special_Constants") for c in s if c.text and c.text.strip()]
            found = Layout(_value(area, "File", "file_name"), int(_value(array, "offset")), ELEMENTS.get(element, ""), names, sizes, constants, float(_value(array, "Element_Array", "scaling_factor") or 1), float(_value(array, "Element_Array", "value_offset") or 0))
            why = _fault(found, element, [n for n, *_ in order], _value(array, "axis_index_order"))
            if not why:
                return found
            if found.element:
                raise ValueError(why)
    raise ValueError(why)


def _fault(found: Layout, element: str, numbers: list[int], order: str) -> str | None:
    parts = found.file.split("/")
    checks = {
        f"unsafe file name in the label: {found.file!r}": found.file and not found.file.startswith("/") and ".." not in parts and not set("\\:\0") & set(found.file),
        "only arrays whose last index is fastest": order == "Last Index Fastest",
        f"the axes must be line, sample and perhaps band, not {found.axes}": set(found.axes) in ({"line", "sample"}, {"line", "sample", "band"}) and len(set(found.axes)) == len(found.axes),
        "the axes are not numbered one by one": numbers == list(range(1, len(numbers) + 1)),
        f"unsupported element type: {element}": found.element,
        "an array without elements, or before the start of its file": min(found.sizes) > 0 and found.offset >= 0,
        f"more than {MOST_PIXELS} pixels": found.size("line") * found.size("sample") <= MOST_PIXELS,
    }
    return next((text for text, fine in checks.items() if not fine), None)


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """``product_id, lines, samples, bands, element, binary, layout, problem`` for each label (``*.xml``) of a folder or glob.

    Labels are parsed, and the sizes of their binaries compared with them; a label that
    cannot be used has a problem.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xml,XML}").load(path).select("path", "content")
    schema = pa.schema([("product_id", pa.string()), ("lines", pa.int32()), ("samples", pa.int32()), ("bands", pa.int32()), ("element", pa.string()), ("binary", pa.string()), ("layout", pa.string()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = layout_of(content.decode("utf-8-sig"))
                    binary = name.rsplit("/", 1)[0] + "/" + found.file
                    system, at = place(binary)
                    if (system.get_file_info(at).size or 0) < found.offset + math.prod(found.sizes) * found.dtype.itemsize:
                        raise ValueError("the binary is missing or shorter than its label says")
                    rows.append({"product_id": name, **{n: found.size(a) for a, n in _AXES.items()}, "element": found.element, "binary": binary, "layout": json.dumps(asdict(found))})
                except Exception as e:  # any broken label is a row, not a failed job
                    rows.append({"product_id": name, "problem": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, "product_id string, lines int, samples int, bands int, element string, binary string, layout string, problem string")


def pixels(found: DataFrame, window: tuple[int, int, int, int] | None = None, bands: Sequence[int] | None = None, whole_spectrum: bool = True, filled: bool = True, lines_per_task: int = 256) -> DataFrame:
    """``product_id, band, y, x, v, valid`` of labels in ``layouts``, in the coordinates of ``window`` (x, y, width, height).

    A pixel is valid where its numbers are finite and no special constants: those of all bands
    with ``whole_spectrum``, else its own band's, which alone is then read. ``filled`` puts 0
    (whole numbers) or NaN (others) for numbers that are special. Scaling of the label
    is applied. A window outside the image is an error, as is a label with a problem.
    """
    x, y = (F.lit(window[i]) for i in (0, 1)) if window else (F.lit(0), F.lit(0))
    w, h = (F.lit(window[2]), F.lit(window[3])) if window else (F.col("samples"), F.col("lines"))
    inside = (x >= 0) & (y >= 0) & (w >= 1) & (h >= 1) & (x + w <= F.col("samples")) & (y + h <= F.col("lines"))
    fault = F.when(F.col("problem").isNotNull(), F.concat("product_id", F.lit(": "), "problem")).when(~inside, F.concat(F.lit("the window lies outside the image "), "product_id"))
    # in what is read, as a check in a column that nothing reads is never made
    starts = F.when(fault.isNull(), F.sequence(y, y + h - 1, F.lit(lines_per_task))).otherwise(F.raise_error(fault).cast("array<int>"))
    ranges = found.select("product_id", "binary", "layout", x.alias("x"), y.alias("y"), w.alias("w"), F.explode(starts).alias("first"), (y + h).alias("end"))
    ranges = ranges.repartition("product_id", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                layout = Layout(**json.loads(r["layout"]))
                n = layout.size("band")
                wanted = list(range(n)) if bands is None else list(bands)
                if any(not 0 <= b < n for b in wanted):
                    raise ValueError(f"no such band in {r['product_id']}")
                few = None if whole_spectrum or bands is None else wanted
                last = min(r["first"] + lines_per_task, r["end"])
                step = max(1, BLOCK // (layout.size("sample") * n))
                with opened(r["binary"]) as f:
                    for line in range(r["first"], last, step):
                        cube = layout.read(f, line, min(last, line + step), few)[:, r["x"] : r["x"] + r["w"]]
                        yield from _rows(r, layout, cube, line, wanted, few)

    def _rows(r: dict, layout: Layout, cube: np.ndarray, line: int, wanted: list[int], few: list[int] | None) -> Iterator[pa.RecordBatch]:
        good = layout.good(cube)
        all_good = good.all(axis=2)
        h, w = cube.shape[:2]
        ys, xs = np.repeat(np.arange(line - r["y"], line - r["y"] + h, dtype=np.int32), w), np.tile(np.arange(w, dtype=np.int32), h)
        name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(h * w, np.int32)), pa.array([r["product_id"]])).cast(pa.string())
        for i, b in enumerate(wanted):
            at = i if few is not None else b
            v, own = cube[:, :, at], good[:, :, at]
            number = v.astype(np.float64) * layout.factor + layout.shift
            if filled:
                number = np.where(own | ~np.isfinite(v), number, np.nan if v.dtype.kind == "f" else 0.0)
            valid = own if few is not None else all_good
            yield pa.RecordBatch.from_arrays([name, pa.array(np.full(h * w, b, np.int32)), pa.array(ys), pa.array(xs), pa.array(number.ravel()), pa.array(valid.ravel())], ["product_id", "band", "y", "x", "v", "valid"])

    return ranges.mapInArrow(read, PIXELS)


def read_window(spark: SparkSession, label: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``product_id, y, x, v, valid`` of a window of two-dimensional arrays, numbers as they stand."""
    found = layouts(spark, label)
    flat = F.when(F.col("bands") > 1, F.lit("the label has no two-dimensional image")).otherwise(F.col("problem"))
    return pixels(found.withColumn("problem", flat), window, filled=False).drop("band")


def spectra(cube: DataFrame) -> DataFrame:
    """``product_id, y, x, spectrum, valid``: the bands of each pixel in one array, in order."""
    each = cube.groupBy("product_id", "y", "x").agg(F.array_sort(F.collect_list(F.struct("band", "v"))).alias("s"), F.bool_and("valid").alias("valid"))
    return each.select("product_id", "y", "x", F.transform("s", lambda b: b["v"]).alias("spectrum"), "valid")
