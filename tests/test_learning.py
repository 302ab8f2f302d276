"""The learned opinion and the composite analysis on small made-up inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import baseline, learning
from emberline.plans import analysis
from emberline.sources import satellite


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(12)
    rows = []
    for i in range(600):
        c = ["a", "b", "c"][i % 3]
        rows.append((i, c, f"r{i % 8}", rng.gauss({"a": 0, "b": 3, "c": 6}[c], 1), None if i % 10 == 0 else rng.gauss({"a": 0, "b": 0, "c": 4}[c], 1)))
    return spark.createDataFrame(rows, "k long, label string, region string, x double, y double").cache()


@pytest.fixture(scope="module")
def model(table):
    return learning.train(table, ["x", "y"], ["a", "b", "c"], "label", "region", rounds=5)


def test_scores_sum_to_one_and_are_right(table, model):
    s = learning.score(model, table)
    rows = s.select("label", "model_class", "model_scores").collect()
    assert all(abs(sum(r["model_scores"].values()) - 1) < 1e-9 for r in rows)
    assert sum(r["label"] == r["model_class"] for r in rows) / len(rows) > 0.85
    assert s.columns[:5] == table.columns


def test_no_model_gives_nulls(table):
    assert learning.score(None, table).filter("model_class is not null").count() == 0


def test_effects_add_up(spark, table, model):
    one = table.filter("k = 5")
    e = {r["feature"]: r["effect"] for r in learning.shapley(model, one, table.filter("k < 60"), "k", permutations=8).collect()}
    assert set(e) == {"x", "y"} and -1 <= sum(e.values()) <= 1 and max(map(abs, e.values())) > 0.02


def test_folds_keep_groups_together(table):
    f = learning.grouped_folds(table, "region")
    assert f.select("region", "fold").distinct().count() == table.select("region").distinct().count()


def test_analysis(spark):
    rng = random.Random(2)
    rows = [(i, dt.datetime(2026, 1, 1 + i % 12, 20), 20.0 + rng.random() / 500, 75.0, 5.0 + i % 3, "VIIRS_SNPP_SP", "nominal", "N") for i in range(40)] + [(100 + i, dt.datetime(2026, 1, 12, 9), 25.0 + i, 80.0, 9.0, "VIIRS_SNPP_SP", "high", "D") for i in range(3)]
    det = spark.createDataFrame(rows, "detection_id long, acq timestamp, lat double, lon double, frp double, instrument string, confidence string, daynight string")
    fac = spark.createDataFrame([(1, "Alpha", "steel_metal", 20.0, 75.0, 1500.0), (2, "Far", "cement", 10.0, 70.0, 1200.0)], "ref long, name string, kind string, lat double, lon double, radius_m double")
    ring = [(74.0, 19.0), (76.0, 19.0), (76.0, 21.0), (74.0, 21.0), (74.0, 19.0)]
    areas = spark.createDataFrame([(1, "State", [ring], 74.0, 19.0, 76.0, 21.0)], "area_id long, area_name string, rings array<array<struct<x:double,y:double>>>, xmin double, ymin double, xmax double, ymax double")
    profile = baseline.compute(analysis.assign(det, fac), window_days=8, exclude_days=2)
    cover = spark.createDataFrame([(100, 0.9, "cropland")], "cluster long, lc_crop double, lc_dominant string")
    s, d = analysis.analyse(det, fac, areas, F.lit(11), cover=cover, profile=profile)
    got = {r["cluster"]: r for r in s.collect()}
    assert set(got) == {0, 100, 101, 102} and d.count() == 43
    flare = got[0]
    assert (flare["thermal_class"], flare["site_ref"], flare["site_within"], flare["state"], flare["baseline_scope"], flare["baseline_known"]) == ("industrial_persistent", 1, True, "State", "facility", True)
    assert got[100]["thermal_class"] == "agricultural_burning" and got[100]["site_within"] is False and got[100]["site_ref"] == 1 and got[101]["state"] is None and got[101]["baseline_known"] is False
    assert got[101]["frp_z"] == 9.0 and flare["model_class"] is None
    (r,) = analysis.run_summary(s, det).collect()
    assert (r["sources"], r["detections"], r["month"]) == (4, 43, 1)


def test_land_cover(spark):
    d = spark.createDataFrame([(1, [40, 40, 10, 0]), (2, [0, 0]), (3, [])], "k long, codes array<int>")
    got = {r["k"]: r for r in satellite.cover_fractions(d).collect()}
    assert (got[1]["lc_crop"], got[1]["lc_tree"], got[1]["lc_dominant"]) == (pytest.approx(2 / 3), pytest.approx(1 / 3), "cropland") and got[2]["lc_crop"] is None and got[3]["lc_dominant"] is None
