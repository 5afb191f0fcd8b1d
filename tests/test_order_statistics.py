"""Exact percentiles, running numbers and points that keep a distance, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiepoint.operators import numbering, quantiles, raster, suppression


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(4)
    groups = {"ties": rng.integers(0, 4, 3000).astype(float), "wide": np.exp(rng.normal(0, 60, 3000)), "one": np.array([7.0]), "two": np.array([-1.0, 3.0]), "same": np.full(2000, 0.1), "signs": np.concatenate([-np.exp(rng.normal(0, 9, 1500)), np.exp(rng.normal(0, 9, 1500)), [0.0, -0.0, np.inf, -np.inf]])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("ties", None), ("ties", float("nan")), ("none", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = (0.0, 0.01, 0.5, 0.333, 0.99, 1.0)
    for few, accuracy in ((4096, 10_000), (20, 100), (1, 40)):
        got = {r["k"]: r["p"] for r in quantiles.percentiles(df, ["k"], "v", shares, few, accuracy).collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            v = np.sort(v)
            for s, p in zip(shares, got[k], strict=True):
                at = s * (len(v) - 1)
                lo, hi, part = v[int(np.floor(at))], v[int(np.ceil(at))], at - np.floor(at)
                assert p == (lo if lo == hi or part == 0 else lo * (1 - part) + hi * part), (few, k, s)
    assert quantiles.percentiles(df.where("k = 'none'"), ["k"], "v", shares).count() == 0


def test_no_plan_holds_the_distinct_values(spark):
    px = spark.range(2000).select(F.lit("p").alias("product_id"), F.lit(0).alias("band"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), F.rand(1).alias("v"), F.lit(True).alias("valid"))
    plan = raster.stretch(px)._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan
    gray = raster.stretch(px).agg(F.min("gray"), F.max("gray")).first()
    assert tuple(gray) == (0, 255)
    with pytest.raises(Exception, match="intensity"):
        raster.stretch(px.withColumn("v", F.lit(1.0))).collect()
    with pytest.raises(Exception, match="intensity"):
        raster.stretch(px.withColumn("valid", F.lit(False))).collect()


def test_numbers_within_groups_of_any_size(spark):
    rows = [(g, (i * 7919) % n, i) for g, n in (("a", 5000), ("b", 1), ("c", 300)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o long, x long").repartition(9)
    got = numbering.numbered(df, ["g"], ["o"]).collect()
    sizes = {"a": 5000, "b": 1, "c": 300}
    assert len(got) == len(rows) and all(r["nth"] == r["o"] and r["of"] == sizes[r["g"]] for r in got)


def scan(points, distance):
    stays = []
    for k, x, y, _ in sorted(points, key=lambda p: (-p[3], p[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= distance**2 for _, a, b in stays):
            stays.append((k, x, y))
    return {k for k, *_ in stays}


@pytest.mark.parametrize("wide", [8, 64])
def test_kept_points_equal_a_sorted_scan(spark, wide):
    rng = np.random.default_rng(wide)
    sets = {
        "random": [(i, *rng.uniform(-50, 150, 2).tolist(), float(rng.integers(0, 40))) for i in range(900)],
        "chain": [(i, i * 1.9, 0.0, float(i)) for i in range(150)],  # every point has a stronger neighbour
        "crowd": [(i, 5.0, 5.0, 1.0) for i in range(50)],
        "grid": [(i, float(i % 20) * 3, float(i // 20) * 3, 1.0) for i in range(400)],
    }
    rows = [(n, k, x, y, r, "more") for n, p in sets.items() for k, x, y, r in p] + [("random", 9999, None, 1.0, 1.0, "more")]
    df = spark.createDataFrame(rows, "product_id string, kp_id long, x double, y double, response double, extra string")
    got = {}
    for r in suppression.keep_apart(df, 3.0, wide).collect():
        got.setdefault(r["product_id"], set()).add(r["kp_id"])
        assert r["extra"] == "more"
    assert got == {n: scan(p, 3.0) for n, p in sets.items()}
    assert suppression.keep_apart(df.limit(0), 3.0).count() == 0


def test_weakest_points_have_no_response(spark):
    df = spark.createDataFrame([("p", 1, 0.0, 0.0, None), ("p", 2, 1.0, 0.0, -5.0), ("p", 3, 40.0, 0.0, float("nan"))], "product_id string, kp_id long, x double, y double, response double")
    assert {r["kp_id"] for r in suppression.keep_apart(df, 2.0).collect()} == {2, 3}
