import numpy as np
import pytest
from pyspark.sql import functions as F

from tiepoint.operators import raster, refine, tiles
from tiepoint.sources import archives, arrays, images, tables


def pixels(spark, a, product="p"):
    h, w = a.shape[:2]
    a = a.reshape(h, w, -1)
    return spark.createDataFrame([(product, b, y, x, float(a[y, x, b]), True) for b in range(a.shape[2]) for y in range(h) for x in range(w)], "product_id string, band int, y int, x int, v double, valid boolean")


def image(df, value="v"):
    rows = df.collect()
    out = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1))
    for r in rows:
        out[r["y"], r["x"]] = r[value]
    return out


@pytest.fixture(scope="module")
def plane():
    return np.random.default_rng(1).integers(0, 255, (45, 52)).astype(float)


def test_stretch_matches_percentiles(spark, plane):
    lo, hi = np.percentile(plane, (1, 99))
    want = np.clip((plane - lo) * 255 / (hi - lo), 0, 255).astype(np.uint8)
    assert np.array_equal(image(raster.stretch(pixels(spark, plane)), "gray"), want)


def test_flat_planes(spark):
    flat = pixels(spark, np.full((3, 3), 7.0))
    assert image(raster.stretch(flat, strict=False), "gray").max() == 0
    with pytest.raises(Exception, match="usable intensity"):
        raster.stretch(flat).collect()


def reference_sobel(a):
    p = np.pad(a, 1, mode="reflect")
    return np.hypot(tiles.correlate(p, tiles.SOBEL_X), tiles.correlate(p, tiles.SOBEL_X.T))


def test_sobel_as_rows_and_as_tiles(spark, plane):
    want = reference_sobel(plane)
    px = pixels(spark, plane)
    assert np.allclose(image(raster.sobel(px), "magnitude"), want)
    assert np.allclose(image(tiles.to_pixels(tiles.sobel_magnitude(tiles.from_pixels(px, 16), 16), 16)), want, atol=1e-3)


def test_local_normalisation_evens_out_brightness(spark, plane):
    a, b = (image(tiles.to_pixels(tiles.local_normalise(tiles.from_pixels(pixels(spark, p), 32), 3.0, size=32), 32)) for p in (plane, plane + 35))
    rows = image(raster.local_normalise(pixels(spark, plane), 3.0), "normal")
    assert np.abs(a - b).mean() < 2 and np.abs(a - rows).max() <= 1


def test_pyramid(spark, plane):
    levels = raster.pyramid(pixels(spark, plane), 3)
    shapes = {r["level"]: (r["h"], r["w"]) for r in levels.groupBy("level").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).collect()}
    assert shapes == {0: (45, 52), 1: (23, 26)}


def test_warp_as_rows_and_as_tiles(spark, plane):
    m = (1.0, 0.0, 4.0, 0.0, 1.0, -2.0, 0.0, 0.0, 1.0)
    px = pixels(spark, plane)
    got = image(raster.warp(px, m, 40, 50))
    want = np.zeros((40, 50))
    want[: 40, 4:] = plane[2:42, : 46]
    assert np.array_equal(got, want)
    t = spark.createDataFrame([("p", list(m))], "product_id string, m array<double>")
    assert np.allclose(image(tiles.to_pixels(tiles.warp(tiles.from_pixels(px, 16), t, 40, 50, 16), 16)), want)


def test_seams_do_not_show_under_a_general_transform(spark, plane):
    m = [1.1, 0.1, -3.0, -0.05, 0.9, 4.0, 0.0002, -0.0001, 1.0]
    px = pixels(spark, plane)
    t = spark.createDataFrame([("p", m)], "product_id string, m array<double>")
    small, whole = (image(tiles.to_pixels(tiles.warp(tiles.from_pixels(px, s), t, 50, 60, s), s)) for s in (8, 64))
    assert np.array_equal(small, whole)
    assert np.allclose(image(raster.warp(px, tuple(m), 50, 60)), whole[:50, :60], atol=1e-3)


def test_principal_plane_follows_the_common_signal(spark):
    t = np.random.default_rng(2).normal(size=(10, 10))
    rows = [("p", y, x, [float(k * t[y, x]) for k in (1, 2, 3)], True) for y in range(10) for x in range(10)]
    df = spark.createDataFrame(rows, "product_id string, y int, x int, spectrum array<double>, valid boolean")
    assert np.corrcoef(image(raster.principal_plane(df)).ravel(), t.ravel())[0, 1] > 0.999


def test_subpixel_refinement(spark):
    rng = np.random.default_rng(4)
    yy, xx = np.mgrid[0:60, 0:60]
    waves = [(rng.uniform(-0.7, 0.7), rng.uniform(-0.7, 0.7), rng.uniform(0, 6)) for _ in range(40)]
    at = lambda dy, dx: sum(np.sin(a * (yy + dy) + b * (xx + dx) + c) for a, b, c in waves) * 20 + 120
    side = lambda a: spark.createDataFrame([("p", y, x, float(a[y, x])) for y in range(60) for x in range(60)], "pair_id string, y int, x int, v double")
    p = spark.createDataFrame([("p", 1, 30.0, 30.0, 30.0, 30.0), ("p", 2, 2.0, 2.0, 2.0, 2.0)], "pair_id string, match_id long, source_x double, source_y double, reference_x double, reference_y double")
    got = {r["match_id"]: r for r in refine.refine(p, side(at(0, 0)), side(at(-1.3, 0.6))).collect()}
    assert got[1]["refined"] and abs(got[1]["reference_x"] - 29.4) < 0.25 and abs(got[1]["reference_y"] - 31.3) < 0.25
    assert not got[2]["refined"] and got[2]["reference_x"] == 2.0


def test_image_files(spark, tmp_path, plane):
    deep = (plane * 200).astype(np.uint16)
    (tmp_path / "a.png").write_bytes(images.encode_png(plane.astype(np.uint8)))
    (tmp_path / "b.tif").write_bytes(images.encode_tiff(deep))
    (tmp_path / "c.tif").write_bytes(b"not an image")
    got = images.read_tiles(spark, str(tmp_path), 32)
    assert {r["product_id"].rsplit("/", 1)[1] for r in got.where("problem is not null").collect()} == {"c.tif"}
    px = tiles.to_pixels(got.where("problem is null").drop("problem"), 32)
    assert np.array_equal(image(px.where(F.col("product_id").endswith("a.png"))), plane)
    assert np.array_equal(image(px.where(F.col("product_id").endswith("b.tif"))), deep)
    assert np.array_equal(images.decode_tiff(images.encode_tiff(deep))[:, :, 0], deep)


LABEL = """<p:Product xmlns:p="urn:x"><File_Area_Observational><File><file_name>{name}</file_name></File><Array_2D_Image><offset>4</offset><axis_index_order>Last Index Fastest</axis_index_order>
<Element_Array><data_type>UnsignedLSB2</data_type></Element_Array><Axis_Array><axis_name>Line</axis_name><elements>5</elements><sequence_number>1</sequence_number></Axis_Array>
<Axis_Array><axis_name>Sample</axis_name><elements>6</elements><sequence_number>2</sequence_number></Axis_Array><Special_Constants><missing>9</missing></Special_Constants></Array_2D_Image></File_Area_Observational></p:Product>"""


def test_window_of_a_labelled_image(spark, tmp_path):
    (tmp_path / "i.bin").write_bytes(bytes(4) + np.arange(30, dtype="<u2").tobytes())
    label = tmp_path / "i.xml"
    label.write_text(LABEL.format(name="i.bin"))
    got = arrays.read_window(spark, str(label), (2, 1, 3, 2))
    assert np.array_equal(image(got), np.arange(30).reshape(5, 6)[1:3, 2:5])
    assert [r["v"] for r in got.where("not valid").collect()] == [9.0]
    for bad, window in (("i.bin", (4, 0, 3, 1)), ("../i.bin", (0, 0, 1, 1))):
        label.write_text(LABEL.format(name=bad))
        with pytest.raises(Exception, match="window|unsafe"):
            arrays.read_window(spark, str(label), window).collect()


def test_archives(spark, tmp_path):
    from zipfile import ZipFile

    xml = "<a:P xmlns:a='u'><a:start_date_time> 2019-10-15T01:02:03Z </a:start_date_time><a:logical_identifier>urn:1</a:logical_identifier></a:P>"
    with ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("browse/ch2_tmc_ncf_20191015T010203_b_brw_d18.png", b"x")
        z.writestr("browse/ch2_tmc_ncf_20191015T010203_b_brw_d18.xml", xml)
        z.writestr("browse/ch2_tmc_nca_20191015T010203_b_brw_d18.png", b"no label")
        z.writestr("../evil.txt", b"e")
    (tmp_path / "two.zip").write_bytes(b"broken")
    found = archives.members(spark, str(tmp_path)).cache()
    assert found.where("problem is not null").count() == 1
    r = archives.browse_products(found, "raw").collect()
    assert [(x["sensor_view"], x["variant"], x["year"], x["product_id"]) for x in r] == [("f", "d18", 2019, "urn:1")]
    assert [x["member"] for x in archives.unsafe(found.where("problem is null")).collect()] == ["../evil.txt"]
    with pytest.raises(ValueError):
        archives.stage(spark, str(tmp_path / "one.zip"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    with ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("data/a.img", b"1")
    assert archives.stage(spark, str(tmp_path / "ok.zip"), str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        archives.stage(spark, str(tmp_path / "ok.zip"), str(tmp_path / "out"))


def test_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿id,source_x,source_y,reference_x,reference_y\na,1,2,24,-12\n", encoding="utf-8")
    assert tables.tie_points(spark, str(tmp_path / "p.csv")).first()["reference_x"] == 24.0
    (tmp_path / "t.json").write_text('{"model": "affine", "direction": "source_to_reference_pixels", "matrix": [[1, 0, 23], [0, 1, -14], [0, 0, 1]]}')
    assert tables.transform(spark, str(tmp_path / "t.json")).first()["m"][2] == 23.0
    (tmp_path / "u.json").write_text('{"model": "affine", "direction": "other", "matrix": [[1, 0, 23], [0, 1, -14], [0, 0, 1]]}')
    with pytest.raises(Exception, match="direction"):
        tables.transform(spark, str(tmp_path / "u.json")).collect()
    assert tables.previous_rows(spark, str(tmp_path / "none.csv"), "pair_id string").count() == 0


def test_image_sinks(spark, tmp_path, plane):
    made = images.whole_images(tiles.from_pixels(pixels(spark, plane), 16), size=16)
    images.write_files(made, str(tmp_path / "out"), ".png")
    with pytest.raises(Exception, match="there already"):
        images.write_files(made, str(tmp_path / "out"), ".png")
    (only,) = (tmp_path / "out").iterdir()
    assert np.array_equal(images.decode_png(only.read_bytes())[:, :, 0], plane)
    with pytest.raises(Exception, match="pixels"):
        images.whole_images(tiles.from_pixels(pixels(spark, plane), 16), size=16, most_pixels=10).collect()
