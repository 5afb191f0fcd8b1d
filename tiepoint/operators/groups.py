"""Groups of nodes that links connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoint.functions.session import materialise


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with a link to another; the root is the least node that it reaches.

    Every round hangs a node's larger neighbours, then its smaller ones, on its least one,
    until no link changes; a chain of n links takes about log n rounds.
    """
    edges = materialise(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("up"), F.least(a, b).alias("low")).distinct())
    digest = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("up", "low").cast("decimal(38,0)"))).first()
    seen = digest(edges)
    while seen[0]:
        ways = edges.select(F.col("up").alias("at"), F.col("low").alias("to")).unionAll(edges.select(F.col("low").alias("at"), F.col("up").alias("to")))
        hub = ways.groupBy("at").agg(F.min("to").alias("hub")).withColumn("hub", F.least("at", "hub"))
        raised = ways.join(hub, "at").where("to > at").select(F.col("to").alias("up"), F.col("hub").alias("low")).distinct()
        small = raised.join(raised.groupBy("up").agg(F.min("low").alias("hub")), "up")
        edges = materialise(small.where("low <> hub").select(F.col("low").alias("up"), F.col("hub").alias("low")).unionAll(small.select("up", F.col("hub").alias("low"))).distinct())
        now = digest(edges)
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("up").alias("node"), F.col("low").alias("root"))
    return ends.unionAll(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
