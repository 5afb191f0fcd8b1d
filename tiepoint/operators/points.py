"""Independent tie points: validation, projection through a saved transform, and the error report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiepoint.functions.geometry import distance, project
from tiepoint.functions.numeric import finite, rmse

COORDINATES = ("source_x", "source_y", "reference_x", "reference_y")
MOST_POINTS = 10_000


def check_points(points: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """``points`` with a ``problem`` column: null for a valid row.

    Ids are trimmed and must be non-empty and unique; coordinates must be finite and
    not negative. Rows beyond ``most`` are a problem of the whole table.
    """
    ids = F.trim(F.col("id").cast("string"))
    copies = F.count("*").over(Window.partitionBy("id"))
    numbers = [F.col(c).cast("double").alias(c) for c in COORDINATES]
    rows = points.select(ids.alias("id"), *numbers).withColumn("copies", copies)
    problem = F.when(F.coalesce(F.col("id"), F.lit("")) == "", "empty id").when(F.col("copies") > 1, "repeated id")
    for c in COORDINATES:
        problem = problem.when(~finite(F.col(c)), f"{c} is not finite").when(F.col(c) < 0, f"{c} is negative")
    total = points.agg(F.count("*").alias("total"))
    rows = rows.withColumn("problem", problem).drop("copies").crossJoin(F.broadcast(total))  # one row
    return rows.withColumn("problem", F.when(F.col("total") > most, f"more than {most} points").otherwise(F.col("problem"))).drop("total")


def valid_points(points: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """The points; reading a row with a problem raises an error."""
    checked = check_points(points, most)
    return checked.where(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("tie point "), F.coalesce("id", F.lit("")), F.lit(": "), F.col("problem"))).cast("boolean"))).drop("problem")


def point_errors(points: DataFrame, m: Column | Sequence[float]) -> DataFrame:
    """Each point with its prediction by a fixed transform, which is never refitted, and the error."""
    x, y = project(F.col("source_x"), F.col("source_y"), m)
    predicted = points.withColumns({"predicted_x": x, "predicted_y": y})
    return predicted.withColumn("error_px", distance(F.col("predicted_x"), F.col("predicted_y"), F.col("reference_x"), F.col("reference_y")))


def error_report(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, RMSE, median, 95th percentile and maximum of ``error_px``."""
    e = F.col("error_px")
    return errors.groupBy(*by).agg(F.count("*").alias("point_count"), rmse(e).alias("rmse_px"), F.median(e).alias("median_px"), F.percentile(e, 0.95).alias("p95_px"), F.max(e).alias("max_px"))


def outside(points: DataFrame, side: str, width: int, height: int) -> DataFrame:
    """Points that lie outside an image of one side."""
    return points.where((F.col(f"{side}_x") >= width) | (F.col(f"{side}_y") >= height))


def nearest_to(points: DataFrame, x: float, y: float, tolerance: float, by: Sequence[str] = ()) -> DataFrame:
    """The point nearest to a place and strictly within the tolerance, one per group; ties to the smaller id."""
    d2 = (F.col("reference_x") - x) * (F.col("reference_x") - x) + (F.col("reference_y") - y) * (F.col("reference_y") - y)
    near = points.withColumn("d2", d2).where(F.col("d2") < tolerance * tolerance)
    return near.groupBy(*by).agg(F.min_by("match_id", F.struct("d2", "match_id")).alias("match_id"), F.min("d2").alias("d2"))
