"""Views that let the operators run on the test tables, which hold no images.

Each view is one list of expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The transform behind the synthetic matches, and the reference image's size.
SHIFT = (1.0, 0.0, 23.0, 0.0, 1.0, -14.0, 0.0, 0.0, 1.0)
WIDTH, HEIGHT = 680, 540

CORR = [
    "o_orderpriority AS pair_id", "o_orderkey AS match_id", "cast(o_orderkey % 640 AS double) AS source_x", "cast((o_orderkey * 7) % 512 AS double) AS source_y",
    "cast(o_orderkey % 640 AS double) + 23e0 + CASE WHEN o_orderstatus <> 'F' THEN (o_custkey % 19 - 9) / 10e0 ELSE 20e0 + o_custkey % 181 END AS reference_x",
    "cast((o_orderkey * 7) % 512 AS double) - 14e0 + CASE WHEN o_orderstatus <> 'F' THEN (o_custkey % 17 - 8) / 10e0 ELSE 20e0 + o_custkey % 179 END AS reference_y",
    "(o_custkey % 11) / 10e0 AS confidence", "o_orderstatus <> 'F' AS inlier",
]
RASTER = [
    "concat('p', n) AS product_id", "0 AS band", "cast(floor(i / 64e0) AS int) AS y", "cast(i % 64 AS int) AS x",
    "cast(((i % 64) * 7 + floor(i / 64e0) * 13 + ((i % 64) * floor(i / 64e0)) % 17 + o_custkey * 5) % 256 AS double) AS v", "(i + o_custkey) % 31 <> 0 AS valid",
]
#: A pixel for every order: planes of 32 x 32, two bands, nodata 0 where the order is pending.
PLANES = [
    "concat('s', o_orderkey // 1024) AS product_id", "cast(floor(o_orderkey % 1024 / 32e0) AS int) AS y", "cast(o_orderkey % 32 AS int) AS x",
    "CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 + o_custkey % 60000 END AS a", "cast(cast(floor(o_totalprice * 100) AS bigint) % 65536 AS int) AS b", "o_orderstatus <> 'P' AS valid",
]
BROWSE = [
    "concat('m', cast(event_id AS string)) AS member", "CASE event_type WHEN 'click' THEN 'f' WHEN 'view' THEN 'n' ELSE 'a' END AS sensor_view", "'b' AS variant", "cast(ts AS timestamp) AS start", "user_id AS owner",
]
METRIC = [
    "concat('pair_', cast(o_orderkey AS string)) AS pair_id", "year(o_orderdate) AS year", "o_orderpriority AS data_level", "o_orderstatus AS pair_type", "CASE WHEN o_custkey % 7 = 0 THEN 'failed' ELSE 'completed' END AS status",
    "cast(floor(o_totalprice / 100) AS bigint) AS inliers", "(o_orderkey % 100) / 100e0 AS inlier_ratio", "(o_custkey % 300) / 100e0 AS residual_rmse_px", "(o_orderkey % 65) / 64e0 AS selected_coverage",
    "concat('s', cast(o_orderkey AS string)) AS source_member", "concat('r', cast(o_custkey AS string)) AS reference_member",
]
MEMBERS = [
    "concat(CASE page_id % 3 WHEN 0 THEN 'ch2_ohr_' WHEN 1 THEN 'x_tmc_' ELSE 'set_' END, cast(page_id % 40 AS string), '.zip') AS archive",
    "concat(CASE page_id % 5 WHEN 0 THEN 'data/calibrated/' WHEN 1 THEN 'browse/raw/' WHEN 2 THEN 'DATA/derived/' WHEN 3 THEN '' ELSE 'geometry/' END, 'f', cast(page_id AS string), CASE page_id % 6 WHEN 0 THEN '.img' WHEN 1 THEN '.PNG' WHEN 2 THEN '.xml' WHEN 3 THEN '.qub' WHEN 4 THEN '.csv' ELSE '.tif' END) AS member",
    "cast(length(html) AS bigint) AS size",
]
VIEWS = {"corr": (CORR, "orders"), "raster": (RASTER, "(SELECT o_orderkey // 1000 AS n, o_custkey, i FROM orders, range(4096) t(i) WHERE o_orderkey % 1000 = 0)"), "planes": (PLANES, "orders"), "browse": (BROWSE, "(SELECT * FROM events WHERE event_type IN ('click', 'view', 'purchase'))"), "metric": (METRIC, "orders"), "members": (MEMBERS, "pages")}

#: Paths as product archives name them, for the classifiers; # is a customer's number.
PATHS = [
    "raw2/OHRC/ch2_ohr_ncp_#_d_img.zip", "data/tmc/ch2_tmc_nrf_#_b_brw_d18.png", "IIRS/ch2_iir_nri_#_d_img.qub", "samples/synthetic_source#.png", "a/sample/ohrc#.png", "mixed/ohrc_vs_tmc-2_#.tif",
    "plain/file#.tif", "x/tmc2_#.tif", "x/tmcs#.tif", "derived/#/iir.img", "calibrated/raw/#.img", "Processed/#.img", "../evil#", "/abs/path#", "C:/win#", "ok\\bad#", "a#/../b", "noext#", "dir.d/noext#", ".hidden#", "archive#.tar.gz", "iirs/TMC_#.zip",
]
_PATH = f"CASE o_orderkey % {len(PATHS)} " + " ".join(f"WHEN {i} THEN replace('{p}', '#', cast(o_custkey AS string))" for i, p in enumerate(PATHS)) + " END"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    exprs, _ = VIEWS[name]
    if name == "raster":
        base = read("orders").where("o_orderkey % 1000 = 0").selectExpr("o_orderkey div 1000 AS n", "o_custkey").crossJoin(F.broadcast(spark.range(4096).withColumnRenamed("id", "i")))  # 4096 rows
    elif name == "browse":
        base = read("events").where("event_type IN ('click', 'view', 'purchase')")
    else:
        base = read({"corr": "orders", "metric": "orders", "planes": "orders", "members": "pages"}[name])
    return base.selectExpr(*(e.replace("//", "DIV") for e in exprs))


def sql(name: str) -> str:
    """The view for a WITH clause."""
    exprs, table = VIEWS[name]
    return f"{name} AS (SELECT {', '.join(exprs)} FROM {table})".replace("AS string)", "AS varchar)")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for every order."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr(_PATH.replace("\\", "\\\\")).alias("path"))


def paths_sql() -> str:
    return f"paths AS (SELECT {_PATH.replace('AS string', 'AS varchar')} AS path FROM orders)"
