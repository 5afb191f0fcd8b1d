"""From archives of browse images to the summary of a batch run."""

from zipfile import ZipFile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiepoint.plans import batch, registration
from tiepoint.sources.images import encode_png

LABEL = "<Product><start_date_time>{}</start_date_time><stop_date_time>x</stop_date_time><logical_identifier>{}</logical_identifier></Product>"


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    """Two readable pairs and one whose image is broken, in one archive; the same names in a second one."""
    source, reference = registration.terrain(spark, ["a", "b"], 180, 220)
    planes = {}
    for view, side in (("f", source), ("n", reference)):
        for r in side.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p")).collect():
            planes[view, r["pair_id"]] = np.array([e["v"] for e in r["p"]]).reshape(180, 220)
    folder = tmp_path_factory.mktemp("archives")
    for name in ("one.zip", "two.zip"):
        with ZipFile(folder / name, "w") as z:
            for n, pair in enumerate("abc"):
                for view in "fn":
                    stamp = f"2019010{n + 1}T000000"
                    stem = f"browse/ch2_tmc_nc{view}_{stamp}_b_brw_d18"
                    z.writestr(f"{stem}.xml", LABEL.format(f"2019-01-0{n + 1}T00:00:00.{int(view == 'n')}Z", f"id{view}{pair}"))
                    z.writestr(f"{stem}.png", b"broken" if pair == "c" else encode_png(planes[view, pair]))
    return folder


def test_batch_run(spark, archive):
    sources = [("raw", str(archive / "two.zip")), ("calibrated", str(archive / "one.zip"))]
    done = batch.register_archives(spark, sources, registration.Config(geometry_model="affine", spatial_selection=True), max_pairs=4)
    rows = done["metrics"].collect()
    assert [r["pair_id"][-5:] for r in sorted(rows, key=lambda r: r["pair_id"][-5:])] == ["00001", "00002", "00003", "00004"]
    assert sorted(r["pair_id"] for r in rows)[0] == "tmc2_calibrated_2019_fn_20190101T000000_00004"
    state = {(r["data_level"], r["source_product_id"]): r["status"] for r in rows}
    assert state == {("raw", "idfa"): "completed", ("raw", "idfb"): "completed", ("raw", "idfc"): "failed", ("calibrated", "idfa"): "completed"}
    assert [r["error"] is None for r in rows] == [r["status"] == "completed" for r in rows]
    assert all(r["inliers"] > 30 for r in rows if r["status"] == "completed")
    assert done["totals"].first().asDict() == {"pairs_total": 4, "pairs_completed": 3, "pairs_failed": 1}
    assert {(r["data_level"], r["pairs_completed"]) for r in done["summary"].collect()} == {("raw", 2), ("calibrated", 1)}
    assert {r["data_level"] for r in done["exemplars"].collect()} == {"raw", "calibrated"} and done["exemplars"].count() == 2
    kept = done["matches"].select("pair_id", "source_x").collect()
    assert kept == sorted(kept) and len(kept) == sum(r["selected_correspondences"] for r in rows if r["status"] == "completed")
    again = batch.register_archives(spark, sources, registration.Config(geometry_model="affine"), previous=done["metrics"])
    # members tell pairs apart here, and the failed one has its like in the other archive
    assert again["manifest"].count() == 2 and again["metrics"].where("status = 'failed'").count() == 2 and again["metrics"].count() == 5


def test_the_usual_configuration_file_loads(tmp_path):
    text = """
matcher: {name: sift, ratio: 0.75, max_features: 6000, descriptor_checkpoint: null}
preprocessing: {clahe: false, local_normalization: false, gradient: false, shadow_mask: false, pyramid_levels: 1, source_band: 0, reference_band: 0}
geometry: {model: homography, ransac_threshold: 3.0, confidence: 0.99}
distribution: {enabled: true, grid_rows: 8, grid_cols: 8, max_matches_per_cell: 10}
refinement: {enabled: false, window_size: 11, search_radius: 3}
cross_modal: {iirs_mode: pca}
"""
    (tmp_path / "c.yaml").write_text(text)
    assert registration.Config.load(str(tmp_path / "c.yaml")) == registration.Config()
    for bad in ({"cross_modal": {"iirs_mode": "mean"}}, {"distribution": {"grid_rows": 0}}, {"matcher": {"ratio": 1}}, {"matcher": {"name": "x"}}):
        with pytest.raises(ValueError):
            registration.Config.of(bad)


def test_a_cube_becomes_its_first_component(spark):
    rng = np.random.default_rng(1)
    t = rng.normal(size=(6, 5))
    rows = [("c", b, y, x, float((b + 1) * t[y, x] + 100), True, True) for b in range(3) for y in range(6) for x in range(5)]
    rows += [("p", b, y, x, float(b * 10 + y), True, False) for b in range(2) for y in range(6) for x in range(5)]
    df = spark.createDataFrame(rows, "pair_id string, band int, y int, x int, v double, valid boolean, cube boolean")
    got = {(r["product_id"], r["y"], r["x"]): r["v"] for r in registration.plane_of(df, 1, registration.Config()).collect()}
    centred = t - t.mean()
    assert all(got["c", y, x] == pytest.approx(centred[y, x] * 14**0.5) for y in range(6) for x in range(5))
    assert all(got["p", y, x] == 10 + y for y in range(6) for x in range(5)) and len(got) == 60
    band = registration.plane_of(df, 1, registration.Config(iirs_mode="band")).where("product_id = 'c'").collect()
    assert all(r["v"] == pytest.approx(2 * t[r["y"], r["x"]] + 100) for r in band)
