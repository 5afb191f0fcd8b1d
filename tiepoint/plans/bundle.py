"""What a registration leaves behind: images, matches, transforms and metrics of all pairs, in one folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.functions.session import materialise
from tiepoint.operators import drawing, tiles
from tiepoint.sources import geotiff, sinks, tables

COLUMNS = ("match_id", "source_x", "source_y", "reference_x", "reference_y", "confidence", "inlier", "selected", "error")


def registered(source: DataFrame, transforms: DataFrame, sizes: DataFrame) -> DataFrame:
    """Source planes ``pair_id, band, y, x, v`` in their reference's grid, as tiles; pairs of one size of reference are warped together."""
    done = transforms.where("m is not null").select(F.col("pair_id").alias("product_id"), "m").join(sizes.withColumnRenamed("pair_id", "product_id"), "product_id")
    done = materialise(done)
    planes = tiles.from_pixels(source.withColumnRenamed("pair_id", "product_id"))
    out = None
    for shape in done.select("height", "width").distinct().collect():  # a plan for each size of image
        own = done.where((F.col("height") == shape["height"]) & (F.col("width") == shape["width"]))
        part = tiles.warp(planes.join(own.select("product_id"), "product_id", "left_semi"), own, shape["height"], shape["width"])
        out = part if out is None else out.unionAll(part)
    return out if out is not None else planes.limit(0)


def geotiffs(found: DataFrame, places: DataFrame | None = None, dtype: str = "f4") -> DataFrame:
    """``name, content``: a GeoTIFF of each product's tiles, all bands; ``places`` has ``pair_id, transform, epsg`` of references that are known on the ground."""
    rows = found.join(places.withColumnRenamed("pair_id", "product_id"), "product_id", "left") if places is not None else found.withColumns({"transform": F.lit(None).cast("array<double>"), "epsg": F.lit(None).cast("int")})

    def encode(table: pa.Table) -> pa.Table:
        rs = table.to_pylist()
        h, w, bands = rs[0]["full_h"], rs[0]["full_w"], sorted({r["band"] for r in rs})
        out = np.zeros((h, w, len(bands)), np.float32)
        for r in rs:
            part = np.frombuffer(r["pixels"], np.float32).reshape(-1, min(tiles.SIZE, w - r["tx"] * tiles.SIZE))
            out[r["ty"] * tiles.SIZE :, r["tx"] * tiles.SIZE :, bands.index(r["band"])][: part.shape[0], : part.shape[1]] = part
        kind = np.dtype(dtype)
        if kind.kind in "ui":
            out = np.clip(np.rint(out), np.iinfo(kind).min, np.iinfo(kind).max)
        place = {"transform": rs[0]["transform"], "epsg": rs[0]["epsg"]} if rs[0]["transform"] and rs[0]["epsg"] else {}
        content = geotiff.encode(out.astype(kind), geotiff.DEFLATE, 3 if kind.kind == "f" else 2, **place)
        return pa.table({"name": pa.array([f"{rs[0]['product_id']}_registered_image"]), "content": pa.array([content], pa.binary())})

    return rows.groupBy("product_id").applyInArrow(encode, "name string, content binary")


def save(spark: SparkSession, found: dict[str, DataFrame], source: DataFrame, reference: DataFrame, folder: str, source_planes: DataFrame | None = None, places: DataFrame | None = None, dtype: str = "f4") -> None:
    """Writes the results of ``register``: ``images`` with a GeoTIFF and the inspection images of each pair, tables of matches, transforms and metrics.

    ``source`` and ``reference`` are 8-bit planes ``pair_id, y, x, v``; ``source_planes``, with all bands, are
    what is warped (the 8-bit ones if not given). Failed pairs have rows in the tables only.
    """
    good = materialise(found["transforms"].where("m is not null").select("pair_id", "m"))
    sizes = materialise(reference.groupBy("pair_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")))
    source, reference = (p.join(good.select("pair_id"), "pair_id", "left_semi") for p in (source, reference))
    chosen = materialise(found["matches"].join(good.select("pair_id"), "pair_id", "left_semi").where("selected"))
    planes = source_planes if source_planes is not None else source.withColumn("band", F.lit(0))
    whole = geotiffs(registered(planes, good, sizes), places, dtype)
    warped = tiles.to_pixels(registered(source.withColumn("band", F.lit(0)), good, sizes)).select(F.col("product_id").alias("pair_id"), "y", "x", F.rint("v").cast("int").alias("v"))
    gray = lambda p: p.select("pair_id", "y", "x", *(F.col("v").cast("int").alias(n) for n in drawing.COLOURS))
    both = warped.withColumnRenamed("v", "a").join(reference.withColumnRenamed("v", "b"), ["pair_id", "y", "x"]).select("pair_id", "y", "x", F.rint((F.col("a") + F.col("b")) / 2).alias("v"))
    pictures = {
        "registered_preview": gray(warped), "source_preview": gray(source), "reference_preview": gray(reference), "overlay": gray(both), "match_visualization": drawing.match_image(source, reference, found["matches"]),
        "error_map": drawing.laid_over(reference, drawing.marker_marks(chosen, "error")), "confidence_map": drawing.laid_over(reference, drawing.marker_marks(chosen, "confidence")),
        "distribution": drawing.laid_over(reference, drawing.distribution_marks(chosen, sizes)),
    }
    files = None
    for name, px in pictures.items():
        part = drawing.colour_files(px, name)
        files = part if files is None else files.unionAll(part)
    sinks.write(files, f"{folder}/images", ".png")
    sinks.write(whole, f"{folder}/images", ".tif")
    for name, rows in (("candidate_matches", found["matches"].select("pair_id", *COLUMNS)), ("matches", chosen.select("pair_id", *COLUMNS)), ("metrics", found["metrics"])):
        tables.write_csv(rows, f"{folder}/{name}_csv")
        rows.write.json(f"{folder}/{name}_json")
    matrix = F.transform(F.array(F.lit(0), F.lit(3), F.lit(6)), lambda i: F.slice("m", i + 1, 3))
    found["transforms"].select("pair_id", "model", matrix.alias("matrix"), F.lit("source_to_reference_pixels").alias("direction")).write.json(f"{folder}/transformation")
