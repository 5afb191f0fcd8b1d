"""Inspection images as pixel rows: previews, matches as lines, maps of markers.

What is drawn is made from its geometry, a row for each pixel of a line or disc, and
laid over the plane by place; where things overlap, the one drawn last stays. So images
of any size and any number of pairs are drawn by the same joins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tiepoint.operators import matches, packing, raster
from tiepoint.sources.images import MOST_PIXELS, encode_png

#: Longest side and percentiles of a preview; colours (blue, green, red) of lines, grid and points; lines of the grid.
MAX_SIDE, LOW, HIGH = 1600, 0.02, 0.98
LINE, GRID, POINT, CELLS = (70, 220, 70), (120, 120, 120), (0, 220, 110), 8
#: Side of the blocks that previews are worked out on.
BLOCK = 512
COLOURS = ("blue", "green", "red")


def shrunk(planes: DataFrame, max_side: int = MAX_SIDE, value: str = "v") -> DataFrame:
    """Planes ``product_id, band, y, x, v`` with no side longer than ``max_side``; smaller ones as they are.

    A pixel of the small plane is the mean of those around its place, weighted by their
    distance, which falls to nothing at one step of the small plane. Tasks pack pixels by
    the block of the small plane that they count for, two where they lie between blocks.
    """
    sizes = planes.groupBy("product_id", "band").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    longest = F.greatest("h", "w")
    scale = F.when(longest > max_side, max_side / longest).otherwise(1.0)
    small = lambda n: F.greatest(F.lit(1), F.rint(F.col(n) * scale)).cast("int")
    rows = planes.join(sizes.select("product_id", "band", "h", "w", small("h").alias("nh"), small("w").alias("nw")), ["product_id", "band"])
    at = lambda c, n, m: (F.col(c) + 0.5) * F.col(m) / F.col(n) - 0.5
    rows = rows.select("product_id", "band", "nh", "nw", F.col(value).cast("double").alias("v"), at("y", "h", "nh").alias("py"), at("x", "w", "nw").alias("px"))
    rows = rows.where("v is not null")
    near = lambda c: F.array_distinct(F.array(F.floor(F.floor(c) / BLOCK), F.floor((F.floor(c) + 1) / BLOCK)))
    rows = rows.withColumn("by", F.explode(near("py"))).withColumn("bx", F.explode(near("px")))
    block = ["product_id", "band", "nh", "nw", "by", "bx"]

    def blend(table: pa.Table) -> pa.Table:
        nh, nw, by, bx = (table.column(c)[0].as_py() for c in block[2:])
        top, left = by * BLOCK, bx * BLOCK
        high, wide = min(BLOCK, nh - top), min(BLOCK, nw - left)
        if high <= 0 or wide <= 0 or top < 0 or left < 0:
            return out.empty_table()
        v, py, px = (packing.unpack(table, c, "f8") for c in ("v", "py", "px"))
        total, weights = np.zeros(high * wide), np.zeros(high * wide)
        for dy in (0, 1):
            for dx in (0, 1):
                y, x = np.floor(py) + dy, np.floor(px) + dx
                w = (1 - np.abs(py - y)) * (1 - np.abs(px - x))
                y, x = y.astype(np.int64) - top, x.astype(np.int64) - left
                own = (w > 0) & (y >= 0) & (y < high) & (x >= 0) & (x < wide)
                at = y[own] * wide + x[own]
                total += np.bincount(at, v[own] * w[own], high * wide)
                weights += np.bincount(at, w[own], high * wide)
        at = np.flatnonzero(weights)
        key = table.slice(0, 1).select(["product_id", "band"]).take(pa.array(np.zeros(len(at), np.int64)))
        for name, values in (("y", at // wide + top), ("x", at % wide + left), ("v", total[at] / weights[at])):
            key = key.append_column(name, pa.array(values))
        return key.cast(out)

    kinds = [f"{c} {planes.schema[c].dataType.simpleString()}" for c in ("product_id", "band")]
    result = ", ".join([*kinds, "y int", "x int", "v double"])
    out = to_arrow_schema(_parse_datatype_string(result))
    return packing.packed(rows, block, {"v": "f8", "py": "f8", "px": "f8"}).groupBy(*block).applyInArrow(blend, result)


def preview(pixels: DataFrame, max_side: int = MAX_SIDE) -> DataFrame:
    """8-bit planes for looking at: stretched between the 2nd and 98th percentile, no side longer than ``max_side``.

    Pixels that do not count are 0, as are planes without contrast.
    """
    gray = raster.stretch(pixels, LOW, HIGH, strict=False).select("product_id", "band", "y", "x", "gray")
    small = shrunk(gray, max_side, "gray")
    return small.withColumn("v", F.floor(F.round("v", 9) + 0.5).cast("int"))


def segments(lines: DataFrame) -> DataFrame:
    """``pair_id, nth, y, x``: the pixels of straight lines ``pair_id, nth, x0, y0, x1, y1`` between rounded ends, a step of the longer side each."""
    r = lambda c: F.rint(c).cast("int").alias(c)
    ends = lines.select("pair_id", "nth", r("x0"), r("y0"), r("x1"), r("y1"))
    steps = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    each = ends.withColumn("steps", steps).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    along = lambda a, b: F.when(F.col("steps") == 0, F.col(a)).otherwise(F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("t") / F.col("steps") + 0.5)).cast("int")
    return each.select("pair_id", "nth", along("y0", "y1").alias("y"), along("x0", "x1").alias("x"))


def discs(points: DataFrame, radius: int, filled: bool = True) -> DataFrame:
    """``points`` (``pair_id, nth, x, y`` and others) once for each pixel of the disc, or ring, around their rounded place."""
    span = range(-radius, radius + 1)
    inner = -1.0 if filled else (radius - 0.5) ** 2
    shape = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in span for dx in span if inner < dy * dy + dx * dx < (radius + 0.5) ** 2]
    each = points.withColumn("_at", F.explode(F.array(*shape)))
    return each.withColumns({"y": (F.rint("y") + F.col("_at.dy")).cast("int"), "x": (F.rint("x") + F.col("_at.dx")).cast("int")}).drop("_at")


def _coloured(marks: DataFrame, colour: Sequence[int | Column], layer: int) -> DataFrame:
    return marks.select("pair_id", "y", "x", F.struct(F.lit(layer).alias("layer"), F.col("nth").cast("long").alias("nth")).alias("order"), *((c if isinstance(c, Column) else F.lit(c)).cast("int").alias(n) for c, n in zip(colour, COLOURS, strict=True)))


def laid_over(canvas: DataFrame, *marks: DataFrame) -> DataFrame:
    """``pair_id, y, x, blue, green, red``: a gray canvas ``pair_id, y, x, v`` with marks over it; marks beyond it are lost."""
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    last = every.groupBy("pair_id", "y", "x").agg(F.max_by(F.struct(*COLOURS), "order").alias("ink"))
    gray = F.col("v").cast("int")
    return canvas.join(last, ["pair_id", "y", "x"], "left").select("pair_id", "y", "x", *(F.coalesce(F.col("ink")[n], gray).alias(n) for n in COLOURS))


def match_marks(found: DataFrame, widths: DataFrame, most: int = 300) -> DataFrame:
    """Lines and rings of each pair's first inliers; the reference lies to the right of the source, whose ``width`` is in ``widths``."""
    first = matches.first_inliers(found, most).join(widths.select("pair_id", "width"), "pair_id")
    first = first.select("pair_id", F.col("match_id").alias("nth"), F.col("source_x").alias("x0"), F.col("source_y").alias("y0"), (F.rint("reference_x") + F.col("width")).alias("x1"), F.col("reference_y").alias("y1"))
    ends = first.select("pair_id", "nth", F.col("x0").alias("x"), F.col("y0").alias("y")).unionAll(first.select("pair_id", "nth", "x1", "y1"))
    return _coloured(segments(first), LINE, 0).unionAll(_coloured(discs(ends, 3, filled=False), LINE, 0))


def match_image(source: DataFrame, reference: DataFrame, found: DataFrame, most: int = 300) -> DataFrame:
    """Gray planes ``pair_id, y, x, v`` side by side with the first inliers as lines; the shorter plane is black below."""
    widths = source.groupBy("pair_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("h"))
    right = reference.join(widths.select("pair_id", "width"), "pair_id").select("pair_id", "y", (F.col("x") + F.col("width")).alias("x"), "v")
    sizes = widths.join(reference.groupBy("pair_id").agg((F.max("x") + 1).alias("rw"), (F.max("y") + 1).alias("rh")), "pair_id")
    # the black below: rows of pixels only where the heights differ
    gap = lambda a, b, left, width: sizes.where(F.col(a) < F.col(b)).select("pair_id", F.explode(F.sequence(F.col(a), F.col(b) - 1)).alias("y"), left.alias("l"), width.alias("n")).select("pair_id", "y", F.explode(F.sequence(F.col("l"), F.col("l") + F.col("n") - 1)).alias("x"), F.lit(0).alias("v"))
    canvas = source.select("pair_id", "y", "x", F.col("v").cast("int").alias("v")).unionAll(right.withColumn("v", F.col("v").cast("int"))).unionAll(gap("h", "rh", F.lit(0), F.col("width"))).unionAll(gap("rh", "h", F.col("width"), F.col("rw")))
    return laid_over(canvas, match_marks(found, widths, most))


def marker_marks(found: DataFrame, kind: str) -> DataFrame:
    """Discs on selected matches' reference points, coloured by error or confidence."""
    c = matches.marker_colours(found).select("pair_id", F.col("match_id").alias("nth"), F.col("marker_x").alias("x"), F.col("marker_y").alias("y"), F.col(f"{kind}_green").alias("g"), F.col(f"{kind}_red").alias("r"))
    return _coloured(discs(c, 3), (0, F.col("g"), F.col("r")), 1)


def distribution_marks(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """The grid's inner lines, and a disc on each reference point; ``sizes`` has ``pair_id, height, width``."""
    part = lambda n: F.rint(F.col("nth") * F.col(n) / CELLS)
    each = sizes.select("pair_id", "height", "width", F.explode(F.sequence(F.lit(1), F.lit(CELLS - 1))).alias("nth"))
    zero = F.lit(0.0)
    rows = each.select("pair_id", "nth", zero.alias("x0"), part("height").alias("y0"), (F.col("width") - 1).cast("double").alias("x1"), part("height").alias("y1"))
    cols = each.select("pair_id", "nth", part("width").alias("x0"), zero.alias("y0"), part("width").alias("x1"), (F.col("height") - 1).cast("double").alias("y1"))
    points = found.select("pair_id", F.col("match_id").alias("nth"), F.col("reference_x").alias("x"), F.col("reference_y").alias("y"))
    return _coloured(segments(rows.unionAll(cols)), GRID, 0).unionAll(_coloured(discs(points, 2), POINT, 1))


def colour_files(pixels: DataFrame, name: str) -> DataFrame:
    """``name, content``: a PNG for each pair, ``<pair>_<name>``; an image file is whole by nature and has MOST_PIXELS at most."""

    def encode(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        if (int(y.max()) + 1) * (int(x.max()) + 1) > MOST_PIXELS:
            raise ValueError(f"more than {MOST_PIXELS} pixels")
        image = np.zeros((y.max() + 1, x.max() + 1, 3), np.uint8)
        for i, c in enumerate(("red", "green", "blue")):
            image[y, x, i] = table.column(c).to_numpy()
        return pa.table({"name": pa.array([f"{table.column('pair_id')[0].as_py()}_{name}"]), "content": pa.array([encode_png(image)], pa.binary())})

    return pixels.groupBy("pair_id").applyInArrow(encode, "name string, content binary")
