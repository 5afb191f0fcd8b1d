"""Registered queries of sources and sinks: what is written as files and read back equals the tables it came from."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.functions import classify
from tiepoint.functions.session import shared_folder
from tiepoint.operators import packing, summary, tiles
from tiepoint.plans import bridge, inventory
from tiepoint.plans.bridge import view
from tiepoint.sources import archives, arrays, geotiff, images, sinks, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_WITH = lambda name: "WITH " + bridge.sql(name)


def _folder(spark: SparkSession) -> str:
    """A new folder among the session's shared ones."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _named(path, suffix: str):
    """The product of a file that ``write_files`` has named."""
    return F.regexp_extract(path, rf"([^/]+)_0\{suffix}$", 1)


@query(f"{_WITH('corr')} SELECT concat(pair_id, '/', match_id) AS id, round(source_x, 6) AS source_x, round(source_y, 6) AS source_y, round(reference_x, 6) AS reference_x, round(reference_y, 6) AS reference_y FROM corr")
def tie_point_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "corr").withColumn("id", F.concat("pair_id", F.lit("/"), F.col("match_id").cast("string")))
    folder = _folder(spark)
    tables.write_csv(c.select(*tables.TIE_POINTS), folder)
    return tables.tie_points(spark, folder).withColumns({n: F.round(n, 6) for n in tables.TIE_POINTS[1:]})


@query(f"{_WITH('metric')} SELECT pair_id, year::BIGINT AS year, status, inliers, round(inlier_ratio, 6) AS inlier_ratio, round(residual_rmse_px, 6) AS residual_rmse_px, round(selected_coverage, 6) AS selected_coverage FROM metric")
def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    tables.write_csv(view(spark, sf_dir, "metric"), folder)
    rows = tables.previous_rows(spark, folder, "pair_id string")
    return rows.select("pair_id", "year", "status", "inliers", *(F.round(c, 6).alias(c) for c in ("inlier_ratio", "residual_rmse_px", "selected_coverage")))


@query("SELECT n_name AS model, n_nationkey + 0.5::DOUBLE AS m2, -n_regionkey::DOUBLE AS m5, 1::DOUBLE AS m8 FROM nation")
def transform_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    row = lambda *v: F.array(*(x.cast("double") for x in v))
    zero, one = F.lit(0), F.lit(1)
    matrix = F.array(row(one, zero, F.col("n_nationkey") + 0.5), row(zero, one, -F.col("n_regionkey")), row(zero, zero, one))
    text = F.to_json(F.struct(F.col("n_name").alias("model"), F.lit("source_to_reference_pixels").alias("direction"), matrix.alias("matrix")))
    folder = _folder(spark)
    images.write_files(n.select(F.col("n_nationkey").cast("string").alias("product_id"), F.lit(0).alias("band"), text.cast("binary").alias("content")), folder, ".json")
    return tables.transform(spark, folder).select("model", *(F.get("m", F.lit(i)).alias(f"m{i}") for i in (2, 5, 8)))


def _images(spark: SparkSession, px: DataFrame, kind: str) -> DataFrame:
    folder = _folder(spark)
    images.write_files(images.whole_images(tiles.from_pixels(px, 24), kind, 24), folder, f".{kind}")
    found = images.read_tiles(spark, folder, 40)
    read = tiles.to_pixels(found.where("problem is null").drop("problem"), 40)
    return read.select(_named(F.col("product_id"), f".{kind}").alias("product_id"), "y", "x", F.col("v").cast("double").alias("v"))


@query(f"{_WITH('raster')} SELECT product_id, y, x, v FROM raster")
def png_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, view(spark, sf_dir, "raster"), "png")


@query(f"{_WITH('raster')} SELECT product_id, y, x, v * 200 + 0.5 AS v FROM raster")
def tiff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, view(spark, sf_dir, "raster").withColumn("v", F.col("v") * 200 + 0.5), "tif")


def _axis(name: str, at: int, size: int) -> str:
    return f"<Axis_Array><axis_name>{name}</axis_name><elements>{size}</elements><sequence_number>{at}</sequence_number></Axis_Array>"


def _label(product: Column, element: str, axes: dict[str, int], special: int) -> Column:
    """A label's text for the binary of ``product``; axes from the slowest."""
    start, end = (
        "<p:Product xmlns:p='urn:x'><File_Area_Observational><File><file_name>",
        f"_0.bin</file_name></File><Array_{len(axes)}D_Image><offset>0</offset><axis_index_order>Last Index Fastest</axis_index_order><Element_Array><data_type>{element}</data_type></Element_Array>"
        + "".join(_axis(n, i + 1, k) for i, (n, k) in enumerate(axes.items())) + f"<Special_Constants><missing_constant>{special}</missing_constant></Special_Constants></Array_{len(axes)}D_Image></File_Area_Observational></p:Product>",
    )
    return F.concat(F.lit(start), product, F.lit(end))


def _written(files: DataFrame, folder: str, suffix: str, content: Column) -> None:
    images.write_files(files.select("product_id", F.lit(0).alias("band"), content.cast("binary").alias("content")), folder, suffix)


def _hex(values: Column, width: int) -> Column:
    """Whole numbers as the bytes of one binary, high byte first."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2 * width, "0")), ""))


@query(f"{_WITH('raster')} SELECT product_id, y - 7 AS y, x - 5 AS x, v, v <> 9 AS valid FROM raster WHERE x >= 5 AND x < 45 AND y >= 7 AND y < 37")
def labelled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same window of every labelled product of a folder."""
    folder = _folder(spark)
    px = view(spark, sf_dir, "raster")

    def plane(table: pa.Table) -> pa.Table:
        import numpy as np

        y, x, v = (packing.unpack(table, c, "i4") for c in "yxv")
        return table.select(["product_id"]).slice(0, 1).append_column("content", pa.array([v[np.lexsort((x, y))].astype(np.uint8).tobytes()], pa.binary()))

    held = packing.packed(px.select("product_id", "y", "x", F.col("v").cast("int").alias("v")), ["product_id"], {c: "i4" for c in "yxv"})
    _written(held.groupBy("product_id").applyInArrow(plane, "product_id string, content binary"), folder, ".bin", F.col("content"))
    _written(px.select("product_id").distinct(), folder, ".xml", _label(F.col("product_id"), "UnsignedByte", {"Line": 64, "Sample": 64}, 9))
    return arrays.read_window(spark, folder, (5, 7, 40, 30)).withColumn("product_id", _named(F.col("product_id"), ".xml"))


#: The three orders in which cubes are usually stored, from the slowest axis.
_ORDERS = (("Band", "Line", "Sample"), ("Line", "Band", "Sample"), ("Line", "Sample", "Band"))
_FULL = lambda source: f"(SELECT * FROM {source} WHERE product_id IN (SELECT product_id FROM {source} GROUP BY 1 HAVING count(*) = 1024))"


@query(f"""{_WITH('planes')}, cubes AS (SELECT product_id, y, x, unnest([a, b, (a + 2 * b) % 65536]) AS v, unnest([0, 1, 2]) AS band, a <> 0 AND b <> 0 AND (a + 2 * b) % 65536 <> 0 AS valid FROM {_FULL('planes')})
SELECT product_id, band, y - 2 AS y, x - 3 AS x, v::DOUBLE AS v, valid FROM cubes WHERE band IN (0, 2) AND y BETWEEN 2 AND 26 AND x BETWEEN 3 AND 30""")
def cube_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bands of a window of cubes whose axes are in any order; a pixel is valid if all bands are."""
    folder = _folder(spark)
    px = view(spark, sf_dir, "planes").withColumn("s", F.array("a", "b", F.expr("(a + 2 * b) % 65536")))
    cubes = px.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "s"))).alias("p")).where(F.size("p") == 1024)
    nth = F.substring("product_id", 2, 20).cast("int") % len(_ORDERS)
    lines = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda y: F.slice(F.col("p.s"), y * 32 + 1, 32))
    of = lambda part, b: F.transform(part, lambda s: F.get(s, F.lit(b)))
    stored = {
        0: F.flatten(F.array(*(of(F.col("p.s"), b) for b in range(3)))),
        1: F.flatten(F.transform(lines, lambda line: F.flatten(F.array(*(of(line, b) for b in range(3)))))),
        2: F.flatten(F.col("p.s")),
    }
    sizes = {"Band": 3, "Line": 32, "Sample": 32}
    for i, order in enumerate(_ORDERS):
        own = cubes.where(nth == i)
        _written(own, folder, ".bin", _hex(stored[i], 2))
        _written(own, folder, ".xml", _label(F.col("product_id"), "UnsignedMSB2", {a: sizes[a] for a in order}, 0))
    found = arrays.pixels(arrays.layouts(spark, folder), (3, 2, 28, 25), (0, 2), lines_per_task=7)
    return found.withColumn("product_id", _named(F.col("product_id"), ".xml"))


def _geotiffs(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a GeoTIFF of two bands for each product: tiles or strips, compressions, predictors, byte orders, places on the ground by turns."""
    folder = _folder(spark)

    def encode(table: pa.Table) -> pa.Table:
        import numpy as np

        name = table.column("product_id")[0].as_py()
        n = int(name[1:])
        image = np.zeros((32, 32, 2), np.uint16)
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        for i, c in enumerate("ab"):
            image[y, x, i] = table.column(c).to_numpy()
        kinds = (geotiff.NONE, geotiff.LZW, geotiff.DEFLATE, geotiff.PACKBITS)
        side = 1.5 + n % 3
        raw = geotiff.encode(
            image, kinds[n % 4], predictor=1 + n % 2, tile=16 if n % 3 else None, rows=5, planar=n % 5 == 1, order="<>"[n % 7 == 2], big=n % 5 == 2,
            transform=(side, 0.0, 1000.0 * n, 0.0, -side * (2 if n % 6 == 4 else 1), 500.0), epsg=32600 + n % 60 + 1 if n % 4 < 3 else 4326, projected=n % 4 < 3, nodata=0.0, tags={"instrument_id": f"cam{n % 3}"},
        )
        return pa.table({"product_id": pa.array([name]), "band": pa.array([0], pa.int32()), "content": pa.array([raw], pa.binary())})

    px = view(spark, sf_dir, "planes").select("product_id", "y", "x", "a", "b")
    images.write_files(px.groupBy("product_id").applyInArrow(encode, "product_id string, band int, content binary"), folder, ".tif")
    return folder


@query(f"{_WITH('planes')}, full_ AS (SELECT unnest(range(0, 1024)) AS i), every AS (SELECT p.product_id, (i // 32)::INT AS y, (i % 32)::INT AS x, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT DISTINCT product_id FROM planes) p, full_ LEFT JOIN planes q ON q.product_id = p.product_id AND q.y = i // 32 AND q.x = i % 32)"
       " SELECT product_id, 1 AS band, y - 4 AS y, x - 3 AS x, b::DOUBLE AS v, a <> 0 AND b <> 0 AS valid FROM every WHERE y BETWEEN 4 AND 28 AND x BETWEEN 3 AND 22")
def geotiff_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second band of a window of every file; blocks outside it are not read."""
    found = geotiff.read(spark, _geotiffs(spark, sf_dir), (3, 4, 20, 25), (1,))
    return found.withColumn("product_id", _named(F.col("product_id"), ".tif"))


@query(f"""{_WITH('planes')}, n AS (SELECT product_id, substr(product_id, 2)::INT AS n FROM planes GROUP BY 1), g AS (SELECT *, 1.5 + n % 3 AS side FROM n)
SELECT product_id, 32 AS width, 32 AS height, 2 AS bands, 'u16' AS dtype, CASE WHEN n % 4 < 3 THEN 'EPSG:' || (32601 + n % 60) ELSE 'EPSG:4326' END AS crs, 1000.0::DOUBLE * n AS west, side::DOUBLE AS side, 0::DOUBLE AS nodata, 'cam' || (n % 3) AS instrument,
CASE WHEN n % 4 < 3 AND n % 6 <> 4 THEN side::DOUBLE END AS pixel_scale, CASE WHEN n % 4 < 3 AND n % 6 <> 4 THEN side::DOUBLE / 2 END AS metadata_scale_ratio FROM g""")
def geotiff_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the directories say, and the scale against a reference of two metres."""
    found = geotiff.headers(spark, _geotiffs(spark, sf_dir))
    return found.select(
        _named(F.col("product_id"), ".tif").alias("product_id"), "width", "height", "bands", "dtype", "crs", F.get("transform", F.lit(2)).alias("west"), F.get("transform", F.lit(0)).alias("side"), "nodata", F.col("tags")["instrument_id"].alias("instrument"),
        "pixel_scale", geotiff.scale_ratio(F.col("pixel_scale"), F.lit(2.0)).alias("metadata_scale_ratio"),
    )


@query(f"""{_WITH('members')} SELECT archive, count(*) AS member_count, sum(size)::BIGINT AS uncompressed_bytes FROM members GROUP BY 1""")
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    m = view(spark, sf_dir, "members").withColumn("content", F.expr("cast(repeat('x', cast(size AS int)) AS binary)"))
    images.write_files(archives.zipped(m), folder, ".zip")
    found = archives.members(spark, folder).withColumn("archive", _named(F.col("archive"), ".zip"))
    return summary.archive_rollup(found.where("problem is null").select("archive", "member", "size")).select("archive", "member_count", "uncompressed_bytes")


_BROWSE = "concat('browse/ch2_tmc_nc', CASE event_type WHEN 'click' THEN 'f' WHEN 'view' THEN 'n' ELSE 'a' END, '_', strftime(ts, '%Y%m%d'), 'T', event_id, '_b_brw_d18.png')"


#: Events whose browse images share their archives.
EVENTS = 100_000


@query(f"SELECT {_BROWSE} AS member, CASE event_type WHEN 'click' THEN 'f' WHEN 'view' THEN 'n' ELSE 'a' END AS sensor_view, concat('urn:', event_id) AS product_id, year(ts)::INT AS year, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS acquisition_start FROM events WHERE event_id % 7 <> 3")
def browse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A browse image for each event, with a label for most of them; those without are left out by the catalogue."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "click", "f").when(F.col("event_type") == "view", "n").otherwise("a")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stem = F.concat(F.lit("browse/ch2_tmc_nc"), kind, F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit("T"), F.col("event_id").cast("string"), F.lit("_b_brw_d18"))
    label = F.concat(F.lit("<p:P xmlns:p='u'><p:start_date_time>"), at, F.lit("Z</p:start_date_time><p:logical_identifier>urn:"), F.col("event_id").cast("string"), F.lit("</p:logical_identifier></p:P>"))
    # an archive is made and listed by one task, so more events make more archives
    archive = F.concat(F.lit("set"), (F.col("user_id") % 20).cast("string"), F.lit("_"), F.expr(f"event_id DIV {EVENTS}").cast("string")).alias("archive")
    both = e.select(archive, F.concat(stem, F.lit(".png")).alias("member"), F.lit("x").cast("binary").alias("content")).unionAll(e.where("event_id % 7 <> 3").select(archive, F.concat(stem, F.lit(".xml")), label.cast("binary")))
    folder = _folder(spark)
    images.write_files(archives.zipped(both), folder, ".zip")
    return archives.browse_products(archives.members(spark, folder), "raw").select("member", "sensor_view", "product_id", "year", "acquisition_start")


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"


_SUFFIX = "lower(regexp_extract(member, '[^/](\\.[^./]+)$', 1))"
_SENSOR = "CASE WHEN contains(archive, 'tmc_') THEN 'TMC-2' WHEN contains(archive, 'ohr') THEN 'OHRC' END"


@query(f"""{_WITH('members')}, a AS (SELECT archive, archive NOT LIKE '%7.zip' AS valid, count(*) FILTER ({_SUFFIX} IN {_in(classify.SCIENCE_SUFFIXES)}) AS science, count(*) FILTER ({_SUFFIX} IN {_in(classify.QUICKLOOK_SUFFIXES)}) AS quick FROM members GROUP BY 1),
o AS (SELECT {_SENSOR} AS sensor, count(*) FILTER (valid) AS archives, count(*) FILTER (valid AND science > 0) AS archives_with_science, sum(science) FILTER (valid) AS science_members, sum(quick) FILTER (valid) AS quicklook_members, count(*) FILTER (NOT valid) AS invalid_archives FROM a GROUP BY 1),
d AS (SELECT CASE page_id % 4 WHEN 0 THEN 'OHRC' WHEN 2 THEN 'TMC-2' ELSE 'IIRS' END AS sensor, count(*) FILTER (page_id % 2 = 0) AS incomplete_downloads, count(*) FILTER (page_id % 4 = 1) AS staged_products, max((page_id % 4 = 3)::INT) AS extracted_products, sum(page_id % 3 + 1) FILTER (page_id % 4 = 1) AS staged_members FROM pages GROUP BY 1)
SELECT s.sensor, {', '.join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ('archives', 'archives_with_science', 'science_members', 'quicklook_members', 'invalid_archives', 'incomplete_downloads', 'staged_products', 'extracted_products', 'staged_members'))}
FROM (VALUES ('OHRC'), ('TMC-2'), ('IIRS')) s(sensor) LEFT JOIN o USING (sensor) LEFT JOIN d USING (sensor)""")
def tree_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of archives (some broken), unfinished downloads, manifests and cubes, written and then counted from its files."""
    folder = _folder(spark)
    m = view(spark, sf_dir, "members")
    broken = F.col("archive").endswith("7.zip")
    images.write_files(archives.zipped(m.where(~broken).withColumn("content", F.lit("x").cast("binary"))), f"{folder}/raw", ".zip")
    text = lambda v: v.cast("binary").alias("content")
    sinks.write(m.where(broken).select(F.col("archive").alias("name"), text(F.lit("no archive"))).distinct(), f"{folder}/raw", ".zip")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("page_id").cast("string").alias("id"))
    kind = F.col("page_id") % 4
    sinks.write(pages.where("page_id % 2 = 0").select(F.concat(F.when(kind == 0, "ohrc_").otherwise("tmc_"), "id").alias("name"), text(F.lit("begun"))), f"{folder}/raw", ".part")
    members = F.transform(F.sequence(F.lit(0), F.col("page_id") % 3), lambda i: F.struct(i.cast("string").alias("member"), F.lit(10).alias("bytes")))
    manifest = F.to_json(F.struct(F.col("id").alias("archive"), members.alias("members")))
    sinks.write(pages.where(kind == 1).select(F.concat(F.lit("p"), "id").alias("name"), text(manifest)), f"{folder}/data/IIRS/staged", "_manifest.json")
    sinks.write(pages.where(kind == 3).select(F.concat(F.lit("c"), "id").alias("name"), text(F.lit("cube"))), f"{folder}/raw/IIRS/product/data/raw", ".qub")
    return inventory.scan(spark, f"{folder}/raw", f"{folder}/data").drop("archive_bytes", "staged_bytes")
