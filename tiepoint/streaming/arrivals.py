"""Products that arrive over time, as streams.

The batch operators work on what has arrived; these take duplicates out and keep
running counts, with state bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(products: DataFrame, delay: str = "1 hour", key: str = "member", at: str = "start") -> DataFrame:
    """First arrival of every product; repeats within the delay are dropped and their state forgotten after it."""
    return products.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def counts(products: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Products by view in windows of their acquisition, final once the watermark has passed."""
    return products.withWatermark("start", delay).groupBy(F.window("start", window), "sensor_view").agg(F.count("*").alias("n")).select(F.col("window.start").alias("from"), "sensor_view", "n")


def paired(source: DataFrame, reference: DataFrame, tolerance: str = "1 second", delay: str = "1 hour") -> DataFrame:
    """Stream-stream join of two views by date, variant and time band; state is kept for the delay alone."""
    a = source.withWatermark("start", delay).select(F.col("member").alias("source_member"), F.col("variant").alias("va"), F.col("start").alias("a"), F.to_date("start").alias("da"))
    b = reference.withWatermark("start", delay).select(F.col("member").alias("reference_member"), F.col("variant").alias("vb"), F.col("start").alias("b"), F.to_date("start").alias("db"))
    band = F.expr(f"b BETWEEN a - INTERVAL {tolerance} AND a + INTERVAL {tolerance}")
    return a.join(b, (F.col("va") == F.col("vb")) & (F.col("da") == F.col("db")) & band).select("source_member", "reference_member", F.col("va").alias("variant"), "a", "b")
