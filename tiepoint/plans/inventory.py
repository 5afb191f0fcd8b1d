"""What a tree of downloads holds, by sensor, from its files alone.

Spark lists the tree once, names and sizes without contents. Archives give their tables of
contents, manifests are parsed, and both are joined to the listing, so an archive without
members or a broken one still counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.functions.classify import sensor_of_file
from tiepoint.operators import summary
from tiepoint.sources import archives

#: Fixed value: what files of a tree are looked at.
WANTED = "*.{zip,part,qub,json}"
MANIFEST = "manifest.json"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, bytes`` of the wanted files below a folder; empty files and those whose names begin with ``_`` or ``.`` are not listed."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", WANTED).option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("bytes"))


def staged(spark: SparkSession, root: str) -> DataFrame:
    """``path, archive, members, bytes`` of the manifests that ``archives.stage`` leaves."""
    rows = spark.read.option("pathGlobFilter", f"*{MANIFEST}").option("recursiveFileLookup", "true").option("multiLine", "true").schema("archive string, members array<struct<member: string, bytes: bigint>>").json(root)
    total = F.aggregate("members", F.lit(0).cast("long"), lambda s, m: s + F.coalesce(m["bytes"], F.lit(0)))
    return rows.select(F.input_file_name().alias("path"), "archive", F.size("members").alias("members"), total.alias("bytes"))


def scan(spark: SparkSession, raw: str, data: str) -> DataFrame:
    """A row for each sensor: valid and invalid archives, their members by kind and bytes, unfinished downloads, staged and extracted products.

    ``raw`` is searched for archives, unfinished downloads and extracted cubes, ``data`` for
    manifests. An extracted product is the third folder above a cube, below the sensor's own.
    """
    files = listing(spark, raw)
    zips = files.where(F.lower("path").endswith(".zip"))
    inside = archives.members(spark, raw, r"(?!)").select(F.col("archive").alias("path"), "member", "problem")
    contents = zips.join(inside, "path", "left").select("path", "member", F.col("problem").isNull().alias("valid"))
    partial = files.where(F.col("path").endswith(".part")).select("path")
    manifests = staged(spark, data)
    counted = summary.sensor_inventory(contents, partial.unionAll(manifests.select(F.regexp_replace("path", r"/[^/]*manifest\.json$", "/x_manifest.json"))))
    sized = zips.join(contents.groupBy("path").agg(F.bool_and("valid").alias("valid")), "path").where("valid")
    sized = sized.groupBy(sensor_of_file(F.col("path")).alias("sensor")).agg(F.sum("bytes").alias("archive_bytes"))
    parts = F.split("path", "/")
    above = F.array_join(F.slice(parts, 1, F.size(parts) - 3), "/")
    cubes = files.where(F.lower("path").endswith(".qub") & F.col("path").contains("/IIRS/")).select(F.lit("IIRS").alias("sensor"), above.alias("product")).distinct()
    extracted = cubes.groupBy("sensor").agg(F.count("*").alias("extracted_products"))
    of = F.get(F.filter(F.array(*(F.when(F.col("path").contains(f"/{s}/"), F.lit(s)) for s in summary.SENSORS)), lambda v: v.isNotNull()), F.lit(0))
    members = manifests.groupBy(of.alias("sensor")).agg(F.sum("members").alias("staged_members"), F.sum("bytes").alias("staged_bytes"))
    out = counted.join(sized, "sensor", "left").join(extracted, "sensor", "left").join(members, "sensor", "left")
    return out.na.fill(0)
