"""Grouped summaries of batch runs, archives and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoint.functions.classify import IMAGE_SUFFIXES, QUICKLOOK_SUFFIXES, SCIENCE_SUFFIXES, data_level, sensor_of_archive, sensor_of_file, suffix

MEDIANS = {"inliers": "median_inliers", "inlier_ratio": "median_inlier_ratio", "residual_rmse_px": "median_residual_rmse_px", "selected_coverage": "median_selected_coverage"}
SENSORS = ("OHRC", "TMC-2", "IIRS")


def batch_summary(metrics: DataFrame) -> DataFrame:
    """Per year, level and pair type: runs, completed runs, and medians over the completed ones."""
    done = F.col("status") == "completed"
    medians = [F.median(F.when(done, F.col(c))).alias(name) for c, name in MEDIANS.items()]
    return metrics.groupBy("year", "data_level", "pair_type").agg(
        F.count("*").alias("pairs_attempted"), F.count_if(done).alias("pairs_completed"), (F.count_if(done) / F.count("*")).alias("success_rate"), *medians,
    )


def status_counts(metrics: DataFrame) -> DataFrame:
    """One row: all pairs, completed and failed ones."""
    return metrics.agg(F.count("*").alias("pairs_total"), F.count_if(F.col("status") == "completed").alias("pairs_completed"), F.count_if(F.col("status") == "failed").alias("pairs_failed"))


def archive_rollup(members: DataFrame) -> DataFrame:
    """Per archive: what its members say. ``members`` has ``archive, member, size``, files only.

    The lists are an archive's own table of contents.
    """
    folders = F.slice(F.split("member", "/"), 1, F.size(F.split("member", "/")) - 1)
    rows = members.withColumns({"suffix": suffix(F.col("member")), "folders": folders})
    names = F.array_sort(F.collect_list("member"))
    grouped = rows.groupBy("archive").agg(
        F.count("*").alias("member_count"), F.sum("size").alias("uncompressed_bytes"),
        F.count_if(F.col("suffix").isin(*IMAGE_SUFFIXES)).alias("image_members"), F.count_if(F.col("suffix") == ".xml").alias("xml_labels"),
        F.bool_or(F.exists("folders", lambda f: F.lower(f) == "data")).alias("has_data_directory"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("folders")))).alias("directories"), names.alias("names"),
    )
    return grouped.withColumns({"sensor": sensor_of_archive(F.col("archive"), F.col("names")), "data_level": data_level(F.col("names"))}).drop("names")


def sensor_inventory(archives: DataFrame, files: DataFrame) -> DataFrame:
    """Counters for each of the three sensors, which are all there even without files.

    ``archives`` has ``path, member, valid`` (a row for each member; one with null member
    for an empty or invalid archive); ``files`` has ``path``: partial downloads and manifests.
    """
    spark = archives.sparkSession
    sensors = spark.createDataFrame([(s,) for s in SENSORS], "sensor string")
    s = suffix(F.col("member"))
    per_archive = archives.groupBy("path").agg(F.bool_and("valid").alias("valid"), F.count_if(s.isin(*SCIENCE_SUFFIXES)).alias("science"), F.count_if(s.isin(*QUICKLOOK_SUFFIXES)).alias("quicklooks"))
    of = per_archive.withColumn("sensor", sensor_of_file(F.col("path"))).groupBy("sensor").agg(
        F.count_if("valid").alias("archives"), F.count_if(F.col("valid") & (F.col("science") > 0)).alias("archives_with_science"), F.sum(F.when(F.col("valid"), F.col("science"))).alias("science_members"),
        F.sum(F.when(F.col("valid"), F.col("quicklooks"))).alias("quicklook_members"), F.count_if(~F.col("valid")).alias("invalid_archives"),
    )
    partial, manifest = F.col("path").endswith(".part"), F.col("path").endswith("_manifest.json")
    found = files.withColumn("sensor", F.when(partial, sensor_of_file(F.col("path"))).when(manifest, F.get(F.filter(F.array(*(F.when(F.col("path").contains(f"/{x}/"), F.lit(x)) for x in SENSORS)), lambda v: v.isNotNull()), F.lit(0))))
    counted = found.groupBy("sensor").agg(F.count_if(partial).alias("incomplete_downloads"), F.count_if(manifest).alias("staged_products"))
    return sensors.join(of, "sensor", "left").join(counted, "sensor", "left").na.fill(0)


def geolocation_totals(index: DataFrame) -> DataFrame:
    """One row: grids, grids with products, declared records, and the archives in order."""
    return index.agg(
        F.count("*").alias("grids"), F.count_if(F.col("found") > 0).alias("grids_with_products"), F.coalesce(F.sum("records"), F.lit(0)).alias("declared_records"), F.array_sort(F.collect_set("archive")).alias("archives"),
    )
