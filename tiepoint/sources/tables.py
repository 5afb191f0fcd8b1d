"""Tables of earlier runs and of tie points: reading with fixed types, writing with a fixed header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

TIE_POINTS = ("id", "source_x", "source_y", "reference_x", "reference_y")
INTEGERS = ("year", "source_keypoints", "reference_keypoints", "candidate_matches", "valid_matches", "inliers", "selected_correspondences", "occupied_cells")
DOUBLES = ("runtime_seconds", "inlier_ratio", "residual_rmse_px", "residual_median_px", "residual_p95_px", "selected_coverage")


def tie_points(spark: SparkSession, path: str) -> DataFrame:
    """Tie points of a CSV file, which may start with a byte-order mark. All columns must be there."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    if missing := set(TIE_POINTS) - set(raw.columns):
        raise ValueError(f"tie points need the columns {', '.join(sorted(missing))}")
    return raw.select("id", *(F.col(c).try_cast("double").alias(c) for c in TIE_POINTS[1:]))


def previous_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an earlier run; none where the file is missing. Counts and measures get their types."""
    try:
        raw = spark.read.csv(path, header=True, nullValue="")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    typed = {c: F.col(c).try_cast("double").cast("long") for c in INTEGERS if c in raw.columns}
    typed |= {c: F.col(c).try_cast("double") for c in DOUBLES if c in raw.columns}
    return raw.withColumns(typed)


def transform(spark: SparkSession, path: str) -> DataFrame:
    """``model, m`` of a saved transform; its direction must be from source to reference pixels."""
    raw = spark.read.json(path, multiLine=True)
    right = F.col("direction") == "source_to_reference_pixels"
    checked = raw.where(F.when(F.coalesce(right, F.lit(False)), True).otherwise(F.raise_error(F.lit("unsupported direction of a saved transform")).cast("boolean")))
    return checked.select("model", F.flatten("matrix").cast("array<double>").alias("m"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; nested columns become JSON text. An existing folder is an error."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables of a registration run, each partitioned by pair."""
    for name, df in tables.items():
        df.write.partitionBy("pair_id").parquet(f"{folder}/{name}")
