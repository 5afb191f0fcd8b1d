"""Batch jobs: cataloguing archives, pairing, registering, merging retries and summarising; experiments and evaluations."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.functions.session import materialise
from tiepoint.operators import pairing, points, summary
from tiepoint.plans.registration import Config, register
from tiepoint.sources import archives, tables


#: Pairs are numbered in this order: archives as given, then by level, year, time and kind.
ORDER = ["place", "data_level", "year", "source_start", "pair_type", "source_member"]


def catalogue(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """Browse products of archives given as (data level, path), with the ``place`` of their archive among them."""
    out = None
    for place, (level, path) in enumerate(sources):
        found = archives.browse_products(archives.members(spark, path), level).withColumn("place", F.lit(place))
        out = found if out is None else out.unionByName(found)
    return out


def manifest(products: DataFrame, tolerance: float = 1.0, previous: DataFrame | None = None) -> DataFrame:
    """Identified pairs of each archive; with earlier metrics only the failed ones, under their old ids."""
    if "place" not in products.columns:
        products = products.withColumn("place", F.lit(0))
    within = ["place", "data_level", "archive"]
    pairs = pairing.pair_views(products, tolerance, within)
    side = lambda s: products.select(*within, F.col("member").alias(f"{s}_member"), F.col("product_id").alias(f"{s}_product_id"), *([F.col("year")] if s == "source" else []))
    for s in ("source", "reference"):
        pairs = pairs.join(side(s), [*within, f"{s}_member"])
    pairs = pairs.withColumnRenamed("archive", "source_archive").withColumn("reference_archive", F.col("source_archive"))
    stamp = F.date_format("source_start", "yyyyMMdd'T'HHmmss")
    named = pairing.number_pairs(pairs, ORDER, F.concat_ws("_", F.lit("tmc2"), "data_level", "year", "pair_type", stamp))
    return named if previous is None else pairing.reuse_ids(pairing.to_retry(named, previous), previous)


def register_archives(spark: SparkSession, sources: list[tuple[str, str]], config: Config | None = None, max_pairs: int = 0, exemplars: int = 1, previous: DataFrame | None = None) -> dict[str, DataFrame]:
    """From archives of browse images, given as (data level, path), to everything that a batch run leaves.

    ``manifest`` has the pairs, ``metrics`` a row for each of them, failed ones with the
    reason, ``matches`` the selected matches in order, ``exemplars`` the first completed
    pairs of each data level and kind, ``summary`` and ``totals`` what became of all. With
    ``max_pairs`` only the first pairs are run; with metrics of an earlier run only those
    that failed there, and the result has the others as they were.
    """
    pairs = manifest(catalogue(spark, sources), previous=previous)
    if max_pairs > 0:
        pairs = pairs.orderBy(*ORDER).limit(max_pairs)
    pairs = materialise(pairs)
    sides = [materialise(archives.member_planes(pairs.select("pair_id", F.col(f"{s}_archive").alias("archive"), F.col(f"{s}_member").alias("member")))) for s in ("source", "reference")]
    broken = sides[0].unionByName(sides[1]).where("problem is not null").groupBy("pair_id").agg(F.min("problem").alias("unreadable"))
    readable = [s.join(broken, "pair_id", "left_anti").drop("problem") for s in sides]
    found = register(*readable, config)
    own = found["metrics"].withColumnRenamed("valid_matches", "matches")
    error = F.coalesce("unreadable", "problem", F.lit("no result"))
    metrics = pairs.join(own.drop("model"), "pair_id", "left").join(broken, "pair_id", "left")
    status = F.coalesce("status", F.lit("failed"))
    metrics = materialise(metrics.withColumns({"status": status, "error": F.when(status == "failed", error)}).drop("problem", "unreadable"))
    context = pairs.select("pair_id", "data_level", "year", "pair_type", "source_product_id", "reference_product_id")
    selected = found["selected"].join(context, "pair_id").orderBy("pair_id", "source_x", "source_y")
    chosen = pairing.first_n(metrics.where("status = 'completed'"), ["data_level", "pair_type"], exemplars).select("pair_id", "data_level", "pair_type")
    if previous is not None:
        metrics = materialise(pairing.merge_retried(previous, metrics.select(*previous.columns)))
    return {"manifest": pairs, "metrics": metrics.orderBy("pair_id"), "matches": selected, "exemplars": chosen, "summary": summary.batch_summary(metrics), "totals": summary.status_counts(metrics)}


def summarise(metrics: DataFrame, again: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per-group summary and totals, after new rows have taken the place of those that were run again."""
    merged = metrics if again is None else pairing.merge_retried(metrics, again)
    return summary.batch_summary(merged), summary.status_counts(merged)


def evaluate(spark: SparkSession, transform_path: str, points_path: str) -> tuple[DataFrame, DataFrame]:
    """Errors and report of independent points under a saved transform."""
    saved = tables.transform(spark, transform_path).limit(1)
    rows = points.valid_points(tables.tie_points(spark, points_path)).crossJoin(F.broadcast(saved))  # one row
    errors = points.point_errors(rows, F.col("m")).drop("m")
    return errors, points.error_report(errors, ["model"])


def experiment(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Config]]:
    """The matrix of declared pairs and variants of a YAML file, and each variant's settings."""
    import yaml

    declared = yaml.safe_load(Path(path).read_text())
    if not isinstance(declared, dict) or not declared.get("pairs") or not declared.get("variants"):
        raise ValueError("an experiment needs pairs and variants")
    folder = Path(path).parent
    settings = {str(v["name"]): Config.with_parameters(v.get("parameters", {})) for v in declared["variants"]}
    pairs = spark.createDataFrame([(declared.get("name", Path(path).stem), p.get("name", Path(p["source"]).name), str((folder / p["source"]).resolve()), str((folder / p["reference"]).resolve()), bool(p.get("synthetic", False))) for p in declared["pairs"]], "experiment string, pair string, source string, reference string, synthetic boolean")
    variants = spark.createDataFrame([(n, c.matcher) for n, c in settings.items()], "method string, matcher string")
    return pairing.experiment_matrix(pairs, variants), settings


def run_experiment(matrix: DataFrame, settings: dict[str, Config], source: DataFrame, reference: DataFrame) -> DataFrame:
    """A row for each cell of the matrix, failed ones with the reason; ``pair_id`` of the planes is the pair's name."""
    out = None
    for method, config in settings.items():
        m = register(source, reference, config)["metrics"]
        rows = matrix.where(F.col("method") == method).join(m.withColumnRenamed("pair_id", "pair"), "pair", "left")
        done = F.coalesce(F.col("status"), F.lit("failed"))
        rows = rows.select("experiment", "pair", "method", "matcher", "synthetic", "source", "reference", done.alias("status"), F.when(done == "failed", F.coalesce("problem", F.lit("the pair could not be loaded"))).alias("error"), F.col("valid_matches").alias("matches"), "inliers", "inlier_ratio", "residual_rmse_px", F.col("selected_coverage").alias("coverage"))
        out = rows if out is None else out.unionByName(rows)
    return out
