import pytest
from pyspark.sql import functions as F

from tiepoint.plans import batch, registration
from tiepoint.streaming import arrivals


def test_registration_finds_a_known_shift(spark):
    source, reference = registration.terrain(spark, ["a"], 200, 240)
    flat = source.withColumns({"pair_id": F.lit("flat"), "v": F.lit(127.0)})
    found = registration.register(source.unionByName(flat), reference.unionByName(flat), registration.Config(geometry_model="affine"))
    m = {r["pair_id"]: r for r in found["metrics"].collect()}
    t = {r["pair_id"]: r for r in found["transforms"].collect()}
    assert m["a"]["status"] == "completed" and m["a"]["inliers"] > 30 and m["a"]["inlier_ratio"] > 0.7
    assert abs(t["a"]["m"][2] - 21) < 1 and abs(t["a"]["m"][5] + 13) < 1
    assert m["flat"]["status"] == "failed" and m["flat"]["problem"]


def test_configuration():
    c = registration.Config.of({"matcher": {"name": "orb", "ratio": 0.8}, "geometry": {"model": "affine"}})
    assert (c.matcher, c.ratio, c.geometry_model) == ("orb", 0.8, "affine")
    for bad in ({"other": {}}, {"matcher": {"x": 1}}, {"matcher": {"ratio": 2}}, {"preprocessing": {"pyramid_levels": 9}}):
        with pytest.raises(ValueError):
            registration.Config.of(bad)
    with pytest.raises(RuntimeError):
        registration.Config(matcher="loftr")


def test_evaluation(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"model": "affine", "direction": "source_to_reference_pixels", "matrix": [[1, 0, 23], [0, 1, -14], [0, 0, 1]]}')
    (tmp_path / "p.csv").write_text("id,source_x,source_y,reference_x,reference_y\na,1,20,24,6\nb,100,50,123,36\n")
    _, report = batch.evaluate(spark, str(tmp_path / "t.json"), str(tmp_path / "p.csv"))
    assert report.first()["rmse_px"] == 0


def test_experiment_matrix(spark, tmp_path):
    (tmp_path / "e.yaml").write_text("name: e\npairs: [{name: p, source: a.tif, reference: b.tif}, {source: c.tif, reference: d.tif}]\nvariants: [{name: v, parameters: {ratio: 0.7}}, {name: w}]\n")
    matrix, settings = batch.experiment(spark, str(tmp_path / "e.yaml"))
    assert matrix.count() == 4 and settings["v"].ratio == 0.7
    (tmp_path / "e.yaml").write_text("pairs: [{source: a, reference: b}]\nvariants: [{name: v, parameters: {nothing: 1}}]\n")
    with pytest.raises(ValueError, match="nothing"):
        batch.experiment(spark, str(tmp_path / "e.yaml"))


def test_manifest_and_retry(spark):
    rows = [(f"{v}{i}.png", v, "d18", f"2019-01-0{i} 00:00:00", f"id{v}{i}", "one.zip", "raw", 2019) for i in (1, 2) for v in "fna"]
    p = spark.createDataFrame(rows, "member string, sensor_view string, variant string, start string, product_id string, archive string, data_level string, year int").withColumn("start", F.to_timestamp("start"))
    m = batch.manifest(p)
    ids = sorted(r["pair_id"] for r in m.collect())
    assert len(ids) == 4 and ids[0].startswith("tmc2_raw_2019_an_20190101T000000_0000")
    old = m.withColumn("status", F.when(F.col("source_member") == "f1.png", "failed").otherwise("completed")).withColumn("pair_id", F.concat(F.lit("old_"), "pair_id"))
    again = batch.manifest(p, previous=old).collect()
    assert [r["source_member"] for r in again] == ["f1.png"] and again[0]["pair_id"].startswith("old_")


def test_stream_of_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "f", "2020-01-01 00:00:00"), ("m1", "f", "2020-01-01 00:00:00"), ("m2", "n", "2020-01-01 00:00:01")], "member string, sensor_view string, start string").withColumn("start", F.to_timestamp("start"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = arrivals.deduplicated(arrivals.arrivals(spark, str(tmp_path / "in"), "member string, sensor_view string, start timestamp"))
    q = stream.writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["member"] for r in spark.sql("select * from seen").collect()) == ["m1", "m2"]


def test_streams_are_paired_and_counted(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "f", "v", "2020-01-01 00:00:00"), ("m2", "n", "v", "2020-01-01 00:00:01"), ("m3", "n", "v", "2020-01-01 00:00:05"), ("m4", "n", "w", "2020-01-01 00:00:00"), ("late", "f", "v", "2020-01-03 00:00:00")], "member string, sensor_view string, variant string, start string").withColumn("start", F.to_timestamp("start"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = lambda v: arrivals.arrivals(spark, str(tmp_path / "in"), "member string, sensor_view string, variant string, start timestamp").where(F.col("sensor_view") == v)
    q = arrivals.paired(seen("f"), seen("n")).writeStream.format("memory").queryName("paired").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["source_member"], r["reference_member"]) for r in spark.sql("select * from paired").collect()] == [("m1", "m2")]
    everything = arrivals.arrivals(spark, str(tmp_path / "in"), "member string, sensor_view string, variant string, start timestamp")
    q = arrivals.counts(everything).writeStream.format("memory").queryName("counted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["sensor_view"], r["n"]) for r in spark.sql("select * from counted").collect()) == [("f", 1), ("n", 3)]


def test_experiment_rows_fail_one_by_one(spark, tmp_path):
    (tmp_path / "e.yaml").write_text("name: e\npairs: [{name: a, source: a.tif, reference: b.tif, synthetic: true}, {name: gone, source: c.tif, reference: d.tif}]\nvariants: [{name: v, parameters: {geometry_model: affine, matcher: orb, ratio: 0.85}}]\n")
    matrix, settings = batch.experiment(spark, str(tmp_path / "e.yaml"))
    rows = {r["pair"]: r for r in batch.run_experiment(matrix, settings, *registration.terrain(spark, ["a"], 160, 200)).collect()}
    assert rows["a"]["status"] == "completed" and rows["a"]["inliers"] > 30 and rows["a"]["error"] is None
    assert rows["gone"]["status"] == "failed" and rows["gone"]["error"] and rows["gone"]["inliers"] is None
