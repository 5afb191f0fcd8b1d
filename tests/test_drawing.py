"""Previews, lines and markers against plain loops; the folder that a registration leaves."""

import json

import numpy as np
from pyspark.sql import functions as F

from tiepoint.operators import drawing
from tiepoint.plans import bundle, registration
from tiepoint.sources import geotiff, images


def pixels(spark, name, plane, key="pair_id"):
    return spark.createDataFrame([(name, y, x, int(plane[y, x])) for y in range(plane.shape[0]) for x in range(plane.shape[1])], f"{key} string, y int, x int, v int")


def image(df, shape):
    out = np.zeros((*shape, 3), int)
    rows = df.collect()
    for r in rows:
        out[r["y"], r["x"]] = (r["blue"], r["green"], r["red"])
    assert len(rows) == shape[0] * shape[1]
    return out


def disc(radius, ring):
    span = range(-radius, radius + 1)
    return [(dy, dx) for dy in span for dx in span if ((radius - 0.5) ** 2 if ring else -1) < dy * dy + dx * dx < (radius + 0.5) ** 2]


def ink(canvas, y, x, colour):
    if 0 <= y < canvas.shape[0] and 0 <= x < canvas.shape[1]:
        canvas[y, x] = colour


def draw_line(canvas, x0, y0, x1, y1, colour):
    n = max(abs(x1 - x0), abs(y1 - y0))
    for t in range(n + 1):
        ink(canvas, int(np.floor(y0 + (y1 - y0) * t / n + 0.5)) if n else y0, int(np.floor(x0 + (x1 - x0) * t / n + 0.5)) if n else x0, colour)


def test_matches_are_drawn_pixel_by_pixel(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (30, 40)), rng.integers(0, 256, (45, 35))
    rows = [("p", i, *rng.uniform(-2, 42, 4).tolist(), bool(i % 3)) for i in range(25)] + [("p", 90, 5.0, 5.0, -35.0, 5.0, True)]
    found = spark.createDataFrame(rows, "pair_id string, match_id long, source_x double, source_y double, reference_x double, reference_y double, inlier boolean")
    got = image(drawing.match_image(pixels(spark, "p", a), pixels(spark, "p", b), found, 12), (45, 75))
    want = np.zeros((45, 75, 3), int)
    want[:30, :40] = a[:, :, None]
    want[:, 40:] = b[:, :, None]
    for _, _, x0, y0, x1, y1, _ in [r for r in rows if r[-1]][:12]:
        x0, y0, x1, y1 = round(x0), round(y0), round(x1) + 40, round(y1)
        draw_line(want, x0, y0, x1, y1, drawing.LINE)
        for x, y in ((x0, y0), (x1, y1)):
            for dy, dx in disc(3, True):
                ink(want, y + dy, x + dx, drawing.LINE)
    assert np.array_equal(got, want)


def test_markers_and_grid(spark):
    plane = np.arange(40 * 50).reshape(40, 50) % 200
    rows = [("p", i, x, y, e, c) for i, (x, y, e, c) in enumerate([(5.0, 6.0, 1.0, 0.5), (7.0, 7.0, 9.0, 1.0), (0.0, 0.0, 0.0, 0.0), (49.6, 39.5, 3.3, 0.25), (20.5, 21.5, 2.0, 0.9)])]
    found = spark.createDataFrame(rows, "pair_id string, match_id long, reference_x double, reference_y double, error double, confidence double")
    canvas = pixels(spark, "p", plane)
    for kind in ("error", "confidence"):
        want = np.repeat(plane[:, :, None], 3, axis=2).copy()
        for _, _, x, y, e, c in rows:
            colour = (0, int(max(0, 255 - e * 50)), int(min(255, e * 50))) if kind == "error" else (0, int(255 * c), int(255 * (1 - c)))
            for dy, dx in disc(3, False):
                ink(want, round(y) + dy, round(x) + dx, colour)
        assert np.array_equal(image(drawing.laid_over(canvas, drawing.marker_marks(found, kind)), (40, 50)), want)
    want = np.repeat(plane[:, :, None], 3, axis=2).copy()
    for k in range(1, 8):
        draw_line(want, 0, round(k * 40 / 8), 49, round(k * 40 / 8), drawing.GRID)
        draw_line(want, round(k * 50 / 8), 0, round(k * 50 / 8), 39, drawing.GRID)
    for _, _, x, y, *_ in rows:
        for dy, dx in disc(2, False):
            ink(want, round(y) + dy, round(x) + dx, drawing.POINT)
    sizes = spark.createDataFrame([("p", 40, 50)], "pair_id string, height int, width int")
    assert np.array_equal(image(drawing.laid_over(canvas, drawing.distribution_marks(found, sizes)), (40, 50)), want)


def test_preview_has_bounded_sides(spark):
    rng = np.random.default_rng(2)
    big, small = rng.normal(100, 30, (37, 90)), rng.normal(0, 1, (8, 9))
    rows = [(n, 0, y, x, float(p[y, x]), not (n == "big" and y == 3)) for n, p in (("big", big), ("small", small), ("flat", np.ones((5, 5)))) for y in range(p.shape[0]) for x in range(p.shape[1])]
    df = spark.createDataFrame(rows, "product_id string, band int, y int, x int, v double, valid boolean")
    got = {}
    for r in drawing.preview(df, 20).collect():
        got.setdefault(r["product_id"], {})[r["y"], r["x"]] = r["v"]
    good = np.ones(big.shape, bool)
    good[3] = False
    lo, hi = np.percentile(big[good], (2, 98))
    gray = np.where(good, np.clip((big - lo) * 255 / (hi - lo), 0, 255).astype(int), 0)
    nh, nw = round(37 * 20 / 90), 20
    for i in range(nh):
        for j in range(nw):
            wy = np.maximum(0, 1 - np.abs((np.arange(37) + 0.5) * nh / 37 - 0.5 - i))
            wx = np.maximum(0, 1 - np.abs((np.arange(90) + 0.5) * nw / 90 - 0.5 - j))
            assert got["big"][i, j] == np.floor((wy @ gray @ wx) / (wy.sum() * wx.sum()) + 0.5)
    assert len(got["big"]) == nh * nw and len(got["small"]) == 72 and set(got["flat"].values()) == {0}


def test_a_registration_leaves_its_folder(spark, tmp_path):
    source, reference = registration.terrain(spark, ["a"], 160, 200)
    flat = source.withColumns({"pair_id": F.lit("flat"), "v": F.lit(127.0)})
    config = registration.Config(geometry_model="affine")
    source, reference = source.unionByName(flat), reference.unionByName(flat)
    found = registration.register(source, reference, config)
    gray = [registration.prepared(registration.plane_of(s, 0, config), config).select(F.col("product_id").alias("pair_id"), "y", "x", "v") for s in (source, reference)]
    places = spark.createDataFrame([("a", [2.0, 0.0, 100.0, 0.0, -2.0, 50.0], 32633)], "pair_id string, transform array<double>, epsg int")
    bundle.save(spark, found, *gray, str(tmp_path / "out"), source, places, "u1")
    names = {p.name for p in (tmp_path / "out" / "images").iterdir()}
    assert names == {f"a_{n}.png" for n in ("registered_preview", "source_preview", "reference_preview", "match_visualization", "overlay", "error_map", "confidence_map", "distribution")} | {"a_registered_image.tif"}
    head = geotiff.headers(spark, str(tmp_path / "out" / "images")).first()
    assert (head["crs"], head["pixel_scale"], head["dtype"], head["width"], head["height"]) == ("EPSG:32633", 2.0, "u8", 200, 160)
    drawn = images.decode_png((tmp_path / "out" / "images" / "a_match_visualization.png").read_bytes())
    assert drawn.shape == (160, 400, 3) and (drawn == np.array(drawing.LINE[::-1])).all(axis=2).sum() > 1000
    rows = [json.loads(line) for p in (tmp_path / "out" / "transformation").glob("*.json") for line in p.read_text().splitlines()]
    m = next(r["matrix"] for r in rows if r["pair_id"] == "a")
    assert abs(m[0][2] - 21) < 1 and abs(m[1][2] + 13) < 1 and {r["pair_id"] for r in rows} == {"a", "flat"}
    selected = spark.read.json(str(tmp_path / "out" / "matches_json"))
    assert 0 < selected.count() <= spark.read.csv(str(tmp_path / "out" / "candidate_matches_csv"), header=True).count() and selected.where("pair_id <> 'a'").count() == 0
