"""GeoTIFF by blocks, labelled arrays and cubes, PNG filters, and the sinks with a commit."""

import io
import itertools
import json
import struct
import zlib
from zipfile import ZipFile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiepoint.operators import raster
from tiepoint.sources import archives, arrays, geotiff, images, sinks
from tiepoint.sources.store import escaped


def whole(raw):
    f = io.BytesIO(raw)
    layout = geotiff.layout_of(geotiff.directory(f))
    out = np.zeros((layout["height"], layout["width"], layout["bands"]), np.float64)
    for nth in range(-(-layout["width"] // layout["block_w"]) * -(-layout["height"] // layout["block_h"])):
        y, x, block = geotiff.read_block(f, layout, nth)
        out[y : y + block.shape[0], x : x + block.shape[1]] = block
    return out


@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "u4", "f4", "f8"])
@pytest.mark.parametrize("tile", [None, 16, 48])
def test_every_way_to_store_an_image(kind, tile):
    rng = np.random.default_rng(len(kind))
    noise, slope = (rng.normal(size=(37, 53, 3)) * 90).astype(kind), (np.arange(37 * 53 * 3).reshape(37, 53, 3) // 50).astype(kind)
    ways = itertools.product((geotiff.NONE, geotiff.LZW, geotiff.DEFLATE, geotiff.PACKBITS), (1, 3) if kind[0] == "f" else (1, 2), (False, True), "<>", (False, True))
    for n, (compression, predictor, planar, order, big) in enumerate(ways):
        image = slope if n % 2 else noise
        assert np.array_equal(whole(geotiff.encode(image, compression, predictor, tile, 17, planar, order, big)), image), (compression, predictor, planar, order, big)


def test_few_bits():
    for bits in (1, 2, 4):
        values = np.random.default_rng(bits).integers(0, 1 << bits, (5, 13))
        packed = np.packbits((values[:, :, None] >> np.arange(bits)[::-1] & 1).astype(np.uint8).reshape(5, -1), axis=1).tobytes()
        fields = [(256, 4, 13), (257, 4, 5), (258, 3, bits), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, 5), (279, 4, len(packed))]
        raw = b"II*\0" + struct.pack("<I", 8 + len(packed)) + packed + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in fields) + bytes(4)
        assert np.array_equal(whole(raw)[:, :, 0], values)


def test_packers_reverse():
    rng = np.random.default_rng(1)
    for n in [*range(0, 4000, 97), 60_000]:
        for data in (rng.integers(0, 256, n).astype(np.uint8).tobytes(), (b"abcabcabd" * n)[:n], bytes(n)):
            assert geotiff.unpack_lzw(geotiff.pack_lzw(data)) == data and geotiff.unpack_bits(geotiff.pack_bits(data)) == data


def test_place_on_the_ground():
    made = lambda **more: geotiff.read_header("x", io.BytesIO(geotiff.encode(np.ones((4, 5), np.uint8), **more)))
    a = made(transform=(2.0, 0, 10.0, 0, -2.01, 20.0), epsg=32633, nodata=-1.5, tags={"instrument_id": "x", "k": "ü"})
    assert (a["crs"], a["projected"], a["transform"], a["nodata"], dict(a["tags"])) == ("EPSG:32633", True, [2.0, 0.0, 10.0, 0.0, -2.01, 20.0], -1.5, {"instrument_id": "x", "k": "ü"})
    assert a["pixel_scale"] == pytest.approx(2.005)
    assert made(transform=(2.0, 0, 0, 0, -2.03, 0), epsg=32633)["pixel_scale"] is None
    assert made(transform=(2.0, 0, 0, 0, -2.0, 0), epsg=4326, projected=False)["pixel_scale"] is None
    turned = made(transform=(1.2, 1.6, 5.0, 1.6, -1.2, 7.0), epsg=32633)
    assert turned["transform"] == [1.2, 1.6, 5.0, 1.6, -1.2, 7.0] and turned["pixel_scale"] == pytest.approx(2.0)
    plain = made()
    assert plain["crs"] is None and plain["transform"] is None and plain["pixel_scale"] is None and plain["nodata"] is None


def test_only_blocks_of_the_window_are_read(spark, tmp_path):
    image = np.arange(64 * 64, dtype=np.uint16).reshape(64, 64)
    raw = bytearray(geotiff.encode(image, geotiff.DEFLATE, tile=16))
    layout = geotiff.layout_of(geotiff.directory(io.BytesIO(bytes(raw))))
    for nth in range(16):
        if nth not in (5, 6, 9, 10):  # the others cannot be decoded any more
            raw[layout["offsets"][nth] : layout["offsets"][nth] + layout["counts"][nth]] = bytes(layout["counts"][nth])
    (tmp_path / "a.tif").write_bytes(bytes(raw))
    got = {(r["y"], r["x"]): r["v"] for r in geotiff.read(spark, str(tmp_path), (17, 16, 31, 30)).collect()}
    assert got == {(y, x): float(image[y + 16, x + 17]) for y in range(30) for x in range(31)}
    with pytest.raises(Exception):
        geotiff.read(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="outside"):
        geotiff.read(spark, str(tmp_path), (60, 0, 5, 1)).collect()


def test_masks_and_broken_files(spark, tmp_path):
    float_ = np.array([[[1.0, 5.0], [np.nan, 6.0]], [[-9.0, 7.0], [2.0, -9.0]]], np.float32)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(float_, geotiff.LZW, 3, nodata=-9.0))
    alpha = np.array([[[1, 0], [2, 255]]], np.uint8)
    (tmp_path / "b.tiff").write_bytes(geotiff.encode(alpha, alpha=True))
    (tmp_path / "c.tif").write_bytes(b"II*\0\xff\xff\xff\x00")
    (tmp_path / "d.tif").write_bytes(b"")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "e.tif").write_bytes(geotiff.encode(np.array([[np.nan, 3.0]]), nodata=float("nan")))
    found = geotiff.headers(spark, str(tmp_path))
    assert {r["product_id"].rsplit("/", 1)[1] for r in found.where("problem is not null").collect()} == {"c.tif"}  # Spark does not list empty files
    rows = {(r["product_id"].rsplit("/", 1)[1], r["band"], r["y"], r["x"]): (r["v"], r["valid"]) for r in geotiff.pixels(found).collect()}
    assert rows["a.tif", 0, 0, 0] == (1.0, True) and rows["a.tif", 0, 1, 0] == (0.0, False) and rows["a.tif", 1, 1, 0] == (7.0, False) and rows["a.tif", 1, 1, 1] == (0.0, False)
    assert np.isnan(rows["a.tif", 0, 0, 1][0]) and not rows["a.tif", 1, 0, 1][1]
    assert rows["b.tiff", 0, 0, 0] == (1.0, False) and rows["b.tiff", 0, 0, 1] == (2.0, True)
    assert rows["e.tif", 0, 0, 0] == (0.0, False) and rows["e.tif", 0, 0, 1] == (3.0, True)


# --- PNG


def brute_filter(image, how):
    """Lines of bytes, filtered one by one as the format says."""
    h, w, step = image.shape
    flat, out = image.reshape(h, -1).astype(int), []
    for y in range(h):
        row = [how[y]]
        for i in range(w * step):
            a, b, c = (flat[y, i - step] if i >= step else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - step] if y and i >= step else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][how[y]]
            row.append((flat[y, i] - guess) % 256)
        out.append(row)
    return np.array(out, np.uint8).tobytes()


def png(w, h, depth, colour, data, extra=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_png_filters(step):
    rng = np.random.default_rng(step)
    for h, w in ((1, 9), (9, 1), (13, 7), (7, 13)):
        image = rng.integers(0, 256, (h, w, step), np.uint8)
        for how in ([0] * h, [1] * h, [2] * h, [3] * h, [4] * h, rng.integers(0, 5, h).tolist()):
            got = images.decode_png(png(w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[step], brute_filter(image, how)))
            assert np.array_equal(got if step != 2 else got[:, :, [0, 3]], image)


def test_png_of_few_bits():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    assert images.decode_png(png(3, 2, 2, 0, bytes([0, 0b00011000, 0, 0b11100100])))[:, :, 0].tolist() == [[0, 85, 170], [255, 170, 85]]
    assert images.decode_png(png(4, 1, 1, 0, bytes([0, 0b01010000]))).tolist() == [[[0, 0, 0], [255, 255, 255], [0, 0, 0], [255, 255, 255]]]
    assert images.decode_png(png(2, 1, 4, 3, bytes([0, 0x10]), chunk(b"PLTE", bytes([1, 2, 3, 7, 8, 9])))).tolist() == [[[7, 8, 9], [1, 2, 3]]]


# --- labelled arrays


def label(file, element, axes, order="Last Index Fastest", special=(), area="File_Area_Observational", scale=""):
    parts = "".join(f"<Axis_Array><axis_name>{n}</axis_name><elements>{k}</elements><sequence_number>{i + 1}</sequence_number></Axis_Array>" for i, (n, k) in enumerate(axes))
    constants = "".join(f"<missing_constant>{s}</missing_constant>" for s in special)
    return f"<p:P xmlns:p='u'><{area}><File><file_name>{file}</file_name></File><Array_{len(axes)}D_Image><offset>4</offset><axis_index_order>{order}</axis_index_order><Element_Array><data_type>{element}</data_type>{scale}</Element_Array>{parts}<Special_Constants>{constants}</Special_Constants></Array_{len(axes)}D_Image></{area}></p:P>"


def test_cubes_of_any_order_of_axes(spark, tmp_path):
    rng = np.random.default_rng(2)
    size = {"Line": 9, "Sample": 5, "Band": 3}
    cube = rng.integers(-50, 50, (9, 5, 3)).astype(">i2")
    for n, order in enumerate(itertools.permutations(size)):
        (tmp_path / f"c{n}.img").write_bytes(b"head" + np.ascontiguousarray(cube.transpose([list(size).index(a) for a in order])).tobytes())
        (tmp_path / f"c{n}.xml").write_text(label(f"c{n}.img", "SignedMSB2", [(a, size[a]) for a in order], special=("7", "nonsense", "1e99")))
    found = arrays.layouts(spark, str(tmp_path))
    every = arrays.pixels(found, lines_per_task=4).collect()
    assert len(every) == 6 * cube.size
    for r in every:
        v = int(cube[r["y"], r["x"], r["band"]])
        assert r["v"] == (0 if v == 7 else v) and r["valid"] == bool((cube[r["y"], r["x"]] != 7).all())
    some = arrays.pixels(found, (1, 2, 3, 6), (2, 0), whole_spectrum=False, filled=False).collect()
    assert len(some) == 6 * 2 * 18 and all(r["v"] == cube[r["y"] + 2, r["x"] + 1, r["band"]] and r["valid"] == (r["v"] != 7) for r in some)
    plane = raster.principal_plane(arrays.spectra(arrays.pixels(found)))
    assert plane.where("valid and v <> 0").count() > 200


def test_labels_that_cannot_be_used(spark, tmp_path):
    (tmp_path / "x.img").write_bytes(bytes(4 + 24))
    axes = [("Line", 4), ("Sample", 6)]
    bad = {
        "unsafe": label("../x.img", "UnsignedByte", axes), "unsafe2": label("C:/x.img", "UnsignedByte", axes), "shorter": label("x.img", "UnsignedLSB2", axes), "missing": label("none.img", "UnsignedByte", axes), "fastest": label("x.img", "UnsignedByte", axes, "First Index Fastest"),
        "axes": label("x.img", "UnsignedByte", [("Line", 4), ("Time", 6)]), "element type": label("x.img", "ComplexLSB8", axes), "no image": "<p><File_Area_Observational/></p>", "not well-formed": "<p>", "without elements": label("x.img", "UnsignedByte", [("Line", 0), ("Sample", 6)]),
    }
    for n, text in bad.items():
        (tmp_path / f"{n}.xml").write_text(text)
    (tmp_path / "good.xml").write_text(label("x.img", "UnsignedByte", axes, scale="<scaling_factor>0.5</scaling_factor><value_offset>3</value_offset>"))
    found = {r["product_id"].rsplit("/", 1)[1][:-4]: r for r in arrays.layouts(spark, str(tmp_path)).collect()}
    assert found["good"]["problem"] is None and all(found[n]["problem"] for n in bad)
    assert all(n.rstrip("2") in found[n]["problem"] for n in bad if n not in ("no image", "not well-formed"))
    assert arrays.read_window(spark, str(tmp_path / "good.xml")).agg(F.min("v"), F.max("v"), F.count("*")).first() == (3.0, 3.0, 24)
    for n in bad:
        with pytest.raises(Exception):
            arrays.read_window(spark, str(tmp_path / f"{n}.xml")).collect()


# --- sinks


def files(spark, *rows):
    return spark.createDataFrame(rows, "name string, content binary").repartition(4)


def test_names_like_each_other_keep_their_files(spark, tmp_path):
    names = ["a/b", "a_b", "a b", "ä", "..", ".", "", "A", "a%2Fb", "~", "x.y"]
    assert len({escaped(n) for n in names}) == len(names) and not {escaped(n) for n in names} & {"", ".", ".."}
    sinks.write(files(spark, *((n, n.encode()) for n in names)), str(tmp_path / "out"), ".bin")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {escaped(n) + ".bin": n.encode() for n in names}


def test_all_files_or_none(spark, tmp_path):
    out = tmp_path / "out"
    sinks.write(files(spark, ("a", b"1"), ("b", b"2")), str(out))
    for rows, why in (([("c", b"3"), ("a", b"4")], "there already"), ([("d", b"5"), ("d", b"6"), ("e", b"7")], "two rows"), ([("f", None)], "without"), ([(None, b"8"), ("g", b"9")], "without")):
        with pytest.raises(Exception, match=why):
            sinks.write(files(spark, *rows), str(out))
    broken = files(spark, *((f"n{i}", b"x") for i in range(40))).withColumn("content", F.when(F.col("name") == "n33", F.raise_error(F.lit("no luck")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no luck"):
        sinks.write(broken, str(tmp_path / "other"))
    assert sorted(p.name for p in out.iterdir()) == ["a", "b"] and (out / "a").read_bytes() == b"1"
    assert [p.name for p in tmp_path.iterdir()] == ["out"]  # no drafts are left
    sinks.write(files(spark, ("c", b"3")), f"file:{out}")
    assert sorted(p.name for p in out.iterdir()) == ["a", "b", "c"]
    with pytest.raises(Exception):
        sinks.write(files(spark, ("c", b"3")), "viewfs://nowhere/x")


def test_an_archive_is_staged_whole_or_not_at_all(spark, tmp_path):
    with ZipFile(tmp_path / "ok.zip", "w") as z:
        for i in range(30):
            z.writestr(f"data/{i % 3}/m{i}.img", bytes([i]) * 1000)
        z.writestr("miscellaneous/foot.SHP", b"shape")
        z.writestr("miscellaneous/foot.dbf", b"table")
        z.writestr("../evil.shp", b"evil")
    found = archives.members(spark, str(tmp_path / "ok.zip"))
    parts = archives.components(found)
    sinks.write(parts, str(tmp_path / "feet"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "feet").iterdir()} == {"ok_foot.SHP": b"shape", "ok_foot.dbf": b"table"}
    with pytest.raises(ValueError, match="unsafe"):
        archives.stage(spark, str(tmp_path / "ok.zip"), str(tmp_path / "out"))
    with ZipFile(tmp_path / "fine.zip", "w") as z:
        for i in range(30):
            z.writestr(f"data/{i % 3}/m{i}.img", bytes([i]) * 1000)
    archives.stage(spark, str(tmp_path / "fine.zip"), str(tmp_path / "out"))
    assert all((tmp_path / "out" / f"data/{i % 3}/m{i}.img").read_bytes() == bytes([i]) * 1000 for i in range(30))
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["archive"] == "fine.zip" and len(manifest["members"]) == 30 and {m["bytes"] for m in manifest["members"]} == {1000}
    raw = bytearray((tmp_path / "fine.zip").read_bytes())
    raw[40 + 500] ^= 1  # a member whose checksum does not hold
    (tmp_path / "bad.zip").write_bytes(bytes(raw))
    with pytest.raises(Exception):
        archives.stage(spark, str(tmp_path / "bad.zip"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() and not [p for p in tmp_path.iterdir() if "drafts" in p.name]
