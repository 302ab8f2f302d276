"""Composite pipelines and small derivations on made-up inputs."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from emberline.plans import pipelines

RING = [(74.0, 19.0), (76.0, 19.0), (76.0, 21.0), (74.0, 21.0), (74.0, 19.0)]
AREA = "area_id long, area_name string, rings array<array<struct<x:double,y:double>>>, xmin double, ymin double, xmax double, ymax double"


def test_master_data(spark):
    schema = "id long, name string, industry string, state string, district string, lat double, lon double, first_seen date, last_seen date"
    d = dt.date(2026, 1, 1)
    left = spark.createDataFrame([(1, "alpha steel", "steel", "s", "d", 20.0, 75.0, d, d), (2, "alpha steel", "steel", "s", "d", 20.0001, 75.0, d, d), (3, "gamma", None, "s", "d", 22.0, 75.0, d, d)], schema)
    right = spark.createDataFrame([(10, "steel alpha", "steel", "s", "d", 20.0002, 75.0, d, dt.date(2026, 2, 1))], schema)
    ledger = spark.createDataFrame([(3, "known")], "source_key long, site_id string")
    rows, pairs, links = pipelines.master_data(left, right, ledger)
    got = sorted(((r["members"], r["record_count"], r["site_id"] == "known", r["last_seen"]) for r in rows.collect()))
    assert got == [([1, 10], 2, False, dt.date(2026, 2, 1)), ([3], 1, True, d)] and pairs.count() == 1 and links.count() == 3
    again, _, _ = pipelines.master_data(left, right, ledger, existing=rows)
    assert sorted(map(str, again.select("site_id", "members").collect())) == sorted(map(str, rows.select("site_id", "members").collect()))


def test_labels(spark):
    rng = random.Random(5)
    rows = [(i, dt.datetime(2025, 10, 1) + dt.timedelta(days=i % 100, hours=20), 20.0, 75.0, 5.0, "VIIRS_SNPP_SP", "nominal", "N") for i in range(100)] + [(500 + i, dt.datetime(2025, 10, 3 + i, 9), 20.5 + rng.random() / 1e4, 75.5, 5.0, "VIIRS_SNPP_SP", "nominal", "D") for i in range(3)]
    rows += [(900 + i, dt.datetime(2025, 10, 1) + dt.timedelta(days=i), 15.0, 70.0, 1.0, "VIIRS_SNPP_SP", "nominal", "D") for i in range(130)]
    det = spark.createDataFrame(rows, "detection_id long, acq timestamp, lat double, lon double, frp double, instrument string, confidence string, daynight string")
    fac = spark.createDataFrame([(1, 20.0, 75.0, 1000.0, True), (2, 10.0, 70.0, 1000.0, False)], "ref long, lat double, lon double, radius_m double, authoritative boolean")
    from emberline.functions import geo

    cover = det.filter("detection_id between 500 and 502").select(geo.cell_key("lat", "lon").alias("cell_key"), F.lit(0.9).alias("lc_crop"), F.lit(0.0).alias("lc_woody")).distinct()
    areas = spark.createDataFrame([(1, "Punjab", [RING], 74.0, 19.0, 76.0, 21.0)], AREA)
    out = pipelines.build_labels(det, fac, cover, areas, "2025-10-01", ["Punjab"], "2025-11-01", per_facility=4)
    got = {(r["label"], r["split"]) for r in out.collect()}
    assert ("agricultural_burning", "unused") in got and out.filter("label = 'industrial_persistent'").count() == 4


def test_facility_build(spark):
    a = spark.createDataFrame([("gem", "1", "A", "cement", 20.0, 75.0, 1200.0, 5.0)], "source string, source_id string, name string, kind string, lat double, lon double, radius_m double, capacity_mw double")
    b = spark.createDataFrame([("osm", "2", None, "cement", 20.001, 75.0, 1200.0)], "source string, source_id string, name string, kind string, lat double, lon double, radius_m double")
    out, links = pipelines.build_facilities([a, b])
    assert out.count() == 1 and links.count() == 2


def test_incident_list(spark):
    w = spark.createDataFrame([("i1", dt.date(2026, 1, 10)), ("i2", dt.date(2026, 1, 10)), ("i3", dt.date(2026, 1, 10))], "incident_id string, event_date date")
    checks = spark.createDataFrame([("i1", True)], "incident_id string, valid boolean")
    geo_ = spark.createDataFrame([("i1", "facility", 20.0, 75.0, None), ("i2", "locality", 30.0, 75.0, None), ("i3", "locality", 31.0, 75.0, 2.0)], "incident_id string, location_quality string, latitude double, longitude double, uncertainty_km double")
    cur = spark.createDataFrame([("i1", 20.0, 75.0, 1.0, "curated")], "incident_id string, lat double, lon double, radius_km double, quality string")
    rej = spark.createDataFrame([("i3",)], "incident_id string")
    det = spark.createDataFrame([(dt.datetime(2026, 1, 10, 9), 20.001, 75.0, 30.0), (dt.datetime(2025, 12, 1, 9), 20.001, 75.0, 2.0)], "acq timestamp, lat double, lon double, frp double")
    got = {r["incident_id"]: (r["location_basis"], r["status"]) for r in pipelines.incident_list(w, checks, geo_, cur, rej, det).collect()}
    assert got == {"i1": ("curated", "matched_anomalous"), "i2": ("locality", "no_detection"), "i3": ("unlocated", None)}


def test_small_derivations(spark):
    p = pipelines
    d = spark.createDataFrame([("a", " ", "c"), (None, "", None)], "x string, y string, z string")
    assert [r[0] for r in d.select(p.address("x", "y", "z")).collect()] == ["a, c", None]
    calls = spark.createDataFrame([("k", dt.datetime(2026, 1, 1, 0, 0, s)) for s in (0, 10, 20, 59)] + [("k", dt.datetime(2026, 1, 1, 0, 1, 0))], "key string, ts timestamp")
    assert sorted(r["ts"].second for r in p.rate_limited(calls, 3).filter("refused").collect()) == [0, 59]
    card = json.dumps({"version": "v", "macro_f1": 0.9, "operating_points": [{"false_alarms_per_day": 0.25, "threshold": 0.7, "recall": 0.5}, {"false_alarms_per_day": 1, "threshold": 0.1}]})
    assert p.model_card(spark.createDataFrame([(card,)], "metrics string")).first()["threshold"] == 0.7
    text = "A huge fire broke out at the Vatva chemical works on 12 January 2026. " * 3
    pages = spark.createDataFrame([(text, "Vatva industrial estate", dt.date(2026, 1, 12)), ("fire vatva", "Vatva", dt.date(2026, 1, 12)), (text, "Surat", dt.date(2025, 1, 12))], "text string, place string, event_date date")
    assert [r["valid"] for r in p.evidence_check(pages).collect()] == [True, False, False]
    hits = spark.createDataFrame([("i", "facility", "place", 1.0, 0), ("i", "facility", "landuse", 1.0, 1), ("i", "locality", "place", 40.0, 2), ("j", "locality", "place", 40.0, 0)], "incident_id string, query_kind string, class string, extent_km double, ord int")
    assert {r["incident_id"]: (r["quality"], r["radius_km"]) for r in p.best_geocode(hits).collect()} == {"i": ("industrial_area", 0.5), "j": ("locality", 8.0)}
    assert [p.next_job(True, 3, 0, 0, 0), p.next_job(False, 2, 60, 1e9, 1e9), p.next_job(False, 2, 200, 1e9, 1e9), p.next_job(False, 0, 0, 5, 700), p.next_job(False, 0, 0, 5, 5)] == ["manual", "wait", "reconcile", "poll", "wait"]
    s = p.merged_status(spark.createDataFrame([("k", {"a": "1", "b": "1"})], "key string, status map<string,string>"), spark.createDataFrame([("k", {"b": "2"})], "key string, status map<string,string>")).first()
    assert s["status"] == {"a": "1", "b": "2"}
    parent = spark.createDataFrame([(1, "P", [RING], 74.0, 19.0, 76.0, 21.0)], AREA)
    inner = [(74.5, 19.5), (75.0, 19.5), (75.0, 20.0), (74.5, 20.0), (74.5, 19.5)]
    child = spark.createDataFrame([(7, "C", [inner], 74.5, 19.5, 75.0, 20.0), (8, "D", [[(x + 10, y) for x, y in inner]], 84.5, 19.5, 85.0, 20.0)], AREA)
    assert [tuple(r) for r in p.areas_inside(parent, child).collect()] == [(1, 7)]
    assert p.pending(spark.range(5).toDF("k"), spark.range(3).toDF("k"), "k").count() == 2
    assert p.slim(spark.createDataFrame([(1.23456789, "a")], "x double, n string"), ["x"], 2).first()[0] == 1.23
