"""Baselines, sources, classifier and alerts on small made-up inputs with known answers."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.operators import alerts, baseline, detections, graph, heat_sources, spatial

DET = "detection_id long, acq timestamp, lat double, lon double, frp double, instrument string, confidence string, daynight string, facility_id long, cell_key string"


def year():
    """A flare seen daily by two satellites, a kiln in December, a bare August cell, and a gap of five days in June."""
    rows, n = [], 0
    first, last = dt.date(2025, 3, 18), dt.date(2026, 3, 31)
    for k in range((last - first).days + 1):
        day = first + dt.timedelta(days=k)
        if dt.date(2025, 6, 10) <= day <= dt.date(2025, 6, 14):
            continue
        at = lambda h: dt.datetime.combine(day, dt.time(h, 30))  # noqa: B023, E731
        todo = [(at(20), 4.0, "VIIRS_SNPP_SP", "nominal", "N", 1, "c1"), (at(21), 6.0, "VIIRS_NOAA20_SP", "nominal", "N", 1, "c1")]
        if day.month == 12 and day.day <= 10:
            todo.append((at(20), 2.0, "VIIRS_SNPP_SP", "nominal", "N", 2, "c2"))
        if day.month == 8 and day.day <= 10:
            todo.append((at(9), 10.0, "VIIRS_SNPP_SP", "nominal", "D", None, "c3"))
        for t in todo:
            n += 1
            rows.append((n, t[0], 20.0 + (t[5] or 9) / 10, 75.0, *t[1:]))
    rows.append((n + 1, dt.datetime(2025, 8, 1, 9, 30), 20.9, 75.0, 10.0, "VIIRS_SNPP_NRT", "nominal", "D", None, "c3"))
    rows.append((n + 2, dt.datetime(2025, 9, 1, 9, 30), 20.9, 75.0, 99.0, "VIIRS_SNPP_SP", "low", "D", None, "c3"))
    return rows


def test_baseline_year(spark):
    got = {(r["scope"], r["key"]): r for r in baseline.compute(spark.createDataFrame(year(), DET)).collect()}
    flare = got["facility", "1"]
    assert (flare["covered_days"], flare["active_days"], flare["n_detections"]) == (360, 360, 720)
    assert (flare["frp_median"], flare["frp_p95"], flare["night_share"], flare["daily_frp_mean"]) == (5.0, 6.0, 1.0, 10.0) and flare["daily_frp_std"] == pytest.approx(0, abs=1e-6)
    assert str(flare["window_start"]) == "2025-03-18" and str(flare["window_end"]) == "2026-03-17"
    kiln, bare = got["facility", "2"], got["cell", "c3"]
    assert kiln["active_days"] == 10 and kiln["monthly_profile"][11] == round(10 / 31, 4) and kiln["monthly_profile"][0] == 0.0
    assert (bare["active_days"], bare["n_detections"], bare["frp_median"]) == (10, 10, 10.0)
    assert kiln["daily_frp_std"] == pytest.approx(math.sqrt(10 * 4 / 360 - (20 / 360) ** 2))


def test_physical_prefers_the_standard_product(spark):
    d = spark.createDataFrame([(1, dt.datetime(2026, 1, 1), 20.00001, 75.0, 1.0, "VIIRS_SNPP_NRT", "nominal", "N", None, None), (2, dt.datetime(2026, 1, 1), 20.00002, 75.0, 2.0, "VIIRS_SNPP_SP", "high", "N", None, None), (3, dt.datetime(2026, 1, 1), 20.0, 75.0, 3.0, "VIIRS_NOAA20_NRT", "low", "N", None, None)], DET)
    assert [r["detection_id"] for r in detections.physical(d).collect()] == [2]


def test_z_score_has_a_floor(spark):
    d = spark.createDataFrame([(10.0, 4.0, 0.2), (10.0, 4.0, 3.0), (7.5, None, None)], "t double, m double, s double")
    assert [r[0] for r in d.select(baseline.z_score("t", "m", "s")).collect()] == [6.0, 2.0, 7.5]


def test_clusters_are_components(spark):
    rng = random.Random(4)
    pts = [(i, 20 + rng.random() * 0.3, 75 + rng.random() * 0.3) for i in range(250)] + [(900, 20.0, 75.0), (901, 20.0, 75.0)]
    got = {r["detection_id"]: r["cluster"] for r in heat_sources.cluster(spark.createDataFrame(pts, "detection_id long, lat double, lon double")).collect()}

    def hav(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    up = {p[0]: p[0] for p in pts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(pts):
        for b in pts[i + 1 :]:
            if hav(a, b) <= 1000:
                x, y = sorted((top(a[0]), top(b[0])))
                up[y] = x
    assert got == {p[0]: top(p[0]) for p in pts}


def test_summary_weighs_by_power(spark):
    t = dt.datetime(2026, 1, 2)
    d = spark.createDataFrame([(1, t, 20.0, 75.0, 1.0, "VIIRS_SNPP_SP", "high", "N", None, None), (1, t - dt.timedelta(hours=30), 20.01, 75.0, 3.0, "VIIRS_NOAA20_SP", "nominal", "D", None, None)], DET.replace("detection_id", "cluster"))
    (s,) = heat_sources.summarise(d, 14).collect()
    assert (s["n_detections"], s["n_days"], s["frp_recent_max"], s["frp_max"], s["night_fraction"], s["instruments"]) == (2, 2, 1.0, 3.0, 0.5, "VIIRS_NOAA20_SP,VIIRS_SNPP_SP")
    assert s["lat"] == pytest.approx(20.0075) and s["extent_m"] == pytest.approx(1113.2)


SOURCE = "cluster long, source_id string, lat double, lon double, site_ref string, site_within boolean, site_name string, site_kind string, site_continuous double, state string, last_seen timestamp, frp_max double, frp_mean double, frp_recent_max double, n_days long, window_days int, hours_since_last double, night_fraction double, extent_m double, lc_crop double, lc_vegetation double, lc_built double, lc_bare double, lc_dominant string"


def source(**k):
    base = dict(cluster=1, source_id="s1", lat=20.0, lon=75.0, site_ref=None, site_within=False, site_name=None, site_kind=None, site_continuous=0.0, state="Gujarat", last_seen=dt.datetime(2026, 1, 1), frp_max=5.0, frp_mean=3.0, frp_recent_max=5.0, n_days=1, window_days=14, hours_since_last=1.0, night_fraction=0.0, extent_m=500.0, lc_crop=None, lc_vegetation=None, lc_built=None, lc_bare=None, lc_dominant=None)
    return tuple({**base, **k}.values())


def test_classifier(spark):
    rows = [
        source(cluster=1, site_ref="r", site_within=True, site_name="Refinery A", site_kind="refinery_petrochem", site_continuous=0.95, n_days=9, night_fraction=0.8),
        source(cluster=2, lc_crop=0.9, lc_dominant="cropland"), source(cluster=3, lc_vegetation=0.9, lc_dominant="tree", frp_max=20.0), source(cluster=4, n_days=8, night_fraction=0.5), source(cluster=5),
        source(cluster=6, site_ref="r", site_within=True, site_kind="landfill", site_continuous=0.35, frp_max=120.0, lc_dominant="built"),
    ]
    got = {r["cluster"]: r for r in heat_sources.classify(spark.createDataFrame(rows, SOURCE), F.lit(11)).collect()}
    assert [got[i]["thermal_class"] for i in range(1, 7)] == ["industrial_persistent", "agricultural_burning", "vegetation_fire", "unmapped_persistent", "other", "industrial_fire_candidate"]
    assert all(sum(r["class_scores"].values()) == pytest.approx(1) for r in got.values())
    assert got[1]["reasons"][0] == "lies on a mapped refinery petrochem (Refinery A)" and got[1]["reasons"][1] == "detected on 9 of the last 14 days"
    assert got[2]["reasons"][0] == "90% cropland around the source (ESA WorldCover)" and got[6]["alert_level"] == "critical" and got[5]["alert_level"] is None


def test_alert_rules(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    inside = dict(site_ref="r1", site_within=True, site_kind="refinery_petrochem", site_name="A")
    rows = [
        (source(cluster=1, source_id="a", frp_max=20.0), 0.7, 0.0), (source(cluster=2, source_id="b", frp_max=20.0), 0.1, 9.0), (source(cluster=3, source_id="c", frp_max=50.0, **inside), 0.1, 3.0),
        (source(cluster=4, source_id="d", frp_max=60.0, **inside), 0.6, 3.5), (source(cluster=5, source_id="e", frp_max=2.0, **inside), 0.9, 9.0), (source(cluster=6, source_id="f", frp_max=90.0, last_seen=dt.datetime(2025, 12, 30)), 0.9, 9.0),
        (source(cluster=7, source_id="g", frp_max=30.0, lc_crop=0.7, night_fraction=0.1), 0.9, 0.0), (source(cluster=8, source_id="h", frp_max=30.0, site_ref="r2", site_within=False), 0.1, 9.0),
    ]
    d = spark.createDataFrame([(*s, {"industrial_fire_candidate": p}, z) for s, p, z in rows], SOURCE + ", class_scores map<string,double>, frp_z double")
    got = {r["facility_key"]: r for r in alerts.candidates(d, now).collect()}
    assert set(got) == {"src:a", "r1"}
    assert (got["r1"]["source_id"], got["r1"]["trigger"], got["r1"]["severity"]) == ("d", "both", "critical") and got["src:a"]["severity"] == "watch"
    assert got["r1"]["summary"] == "CRITICAL: possible industrial fire at A (refinery petrochem), Gujarat - peak 60 MW; P(industrial fire) 60%; power +3.5 sd above this facility's own baseline"
    assert [r["source_id"] for r in alerts.judged(d, now).filter("vetoed").collect()] == ["g"]


@pytest.mark.parametrize("at_limit_new", [True, False])
def test_dedupe_is_a_fold(spark, at_limit_new):
    t = dt.datetime(2026, 1, 1)
    hours = [0, 4, 6, 7, 11.9, 12, 13, 30]
    d = spark.createDataFrame([("k", t + dt.timedelta(hours=h)) for h in hours], "facility_key string, ts timestamp")
    got = [h for h in hours if {r["ts"]: r["created"] for r in alerts.dedupe(d, at_limit_new=at_limit_new).collect()}[t + dt.timedelta(hours=h)]]
    assert got == ([0, 6, 12, 30] if at_limit_new else [0, 7, 30])


def test_greedy_anchors_do_not_chain(spark):
    nodes = spark.createDataFrame([(i, i) for i in range(5)], "key long, ord long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert {r["key"]: r["anchor"] for r in graph.greedy_anchors(nodes, edges, "key").collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_match_takes_the_widest_margin(spark):
    fac = spark.createDataFrame([(1, 20.0, 75.0, 400.0), (2, 20.01, 75.0, 1800.0)], "ref long, lat double, lon double, radius_m double")
    pts = spark.createDataFrame([(1, 20.001, 75.0), (2, 20.5, 75.0)], "k long, lat double, lon double")
    assert [(r["k"], r["ref"]) for r in spatial.match_facilities(pts, fac, "k").collect()] == [(1, 2)]
    near = {r["k"]: r["ref"] for r in spatial.nearest_facility(pts, fac, "k").collect()}
    assert near == {1: 1, 2: 2}


def test_rings(spark):
    sq = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    hole = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5)]
    d = spark.createDataFrame([(0.2, 0.2, [sq, hole]), (1.0, 1.0, [sq, hole]), (3.0, 1.0, [sq, hole])], "x double, y double, rings array<array<struct<x:double,y:double>>>")
    ring = F.col("rings")[0]
    rows = d.select(geo.in_polygon(F.col("x"), F.col("y"), F.col("rings")), geo.ring_area(ring), geo.ring_centroid(ring), geo.ring_valid(ring), geo.ring_bounds(ring)).collect()
    assert [r[0] for r in rows] == [True, False, False] and rows[0][1] == 4.0 and tuple(rows[0][2]) == (1.0, 1.0) and rows[0][3] and tuple(rows[0][4]) == (0.0, 0.0, 2.0, 2.0)


def test_geohash(spark):
    assert spark.range(1).select(geo.geohash(F.lit(57.64911), F.lit(10.40744), 6)).first()[0] == "u4pruy"
