"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; without one a temporary folder, but only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files of plans that nothing refers to any more, which else lie until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch of rows on its way to Python.
BATCH = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Where the session sets no limit, rows go to Python in batches of about BATCH bytes, however long the texts are.

    The limit is the same for all operators, so no result or memory depends on which ran first.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has that name."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name as it stands in an expression, whatever letters it has."""
    return "`" + name.replace("`", "``") + "`"


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link to another one; root is the smallest node reachable.

    Alternating large-star and small-star rounds: each is a min per node (partial
    aggregation) and a join back, which AQE can split for a node with many links.
    Rounds grow with the logarithm of the longest chain and go on until nothing
    changes. Links with a null end and links of a node to itself are ignored.
    """
    a, b = F.col(a), F.col(b)
    edges = materialise(links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(small.select("hi", F.col("m").alias("lo")))
        edges = materialise(small.distinct())
        del both, least, large, small
        release(edges.sparkSession)
        now = state(edges)
        if now == before:
            break
        before = now
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return ends.unionAll(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
