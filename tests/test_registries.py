"""Loaders, names, matching, snapshots, labels, metrics and streams on small made-up inputs."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import ids, text
from emberline.operators import dedupe, evaluation, facilities, imagery, labels, matching, quality, snapshots
from emberline.plans import serving
from emberline.sources import registries, satellite, sinks
from emberline.streaming import live


@pytest.mark.parametrize("raw,want", [
    ("  Alpha  Industrial  Estate Pvt. Ltd. ", "alpha industrial estate pvt ltd"), ("Béta & Sons MFG.", "beta and sons manufacturing"), ("Gamma Engg Works Unit II", "gamma engineering"), ("Delta-Steel/Rolling Private Limited", "delta steel rolling pvt ltd"),
    ("", None), (None, None), ("Plant 3", None), ("Epsilon Industries Phase 2, Division", "epsilon industry"),
])
def test_names(spark, raw, want):
    d = spark.createDataFrame([(raw,)], "n string")
    assert d.select(text.normalise_name(F.col("n"))).first()[0] == want


def test_legal_form_and_match_text(spark):
    d = spark.createDataFrame([("Alpha Pvt. Ltd.", "Un-known"), ("Beta LLP", "unknown"), ("Gamma", "Steel, Works")], "n string, t string")
    assert [tuple(r) for r in d.select(text.legal_form(F.col("n")), text.match_text(F.col("t"))).collect()] == [("pvt ltd", "un known"), ("llp", None), (None, "steel works")]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_similarities(spark):
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert text._lcs(a, b) == lcs(a, b)
    assert text.token_set("alpha steel works", "works alpha") == 100.0 and text.token_set("alpha", "") == 0.0
    assert text.token_set("alpha steel", "alpha cement") == pytest.approx(max(2 * lcs("alpha steel", "alpha cement") / 23, 2 * 5 / 16, 2 * 5 / 17) * 100)
    d = spark.createDataFrame([("alpha", "alpha"), ("alpha", None)], "a string, b string")
    assert [r[0] for r in d.select(text.ratio("a", "b")).collect()] == [100.0, 0.0]


def test_uuid5_is_the_standard_one(spark):
    import uuid

    d = spark.createDataFrame([("gem:1",), ("é",), ("",)], "s string")
    assert [r[0] for r in d.select(ids.uuid5(ids.FACILITY_NAMESPACE, F.col("s"))).collect()] == [str(uuid.uuid5(uuid.UUID(ids.FACILITY_NAMESPACE), s)) for s in ("gem:1", "é", "")]


CSV = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,confidence,version,bright_ti5,frp,daynight\n"


def test_satellite_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV + "20.1,75.2,330,0.4,0.4,2026-01-02,745,N,h,2.0,290,5.5,night\n20.1,75.2,330,0.4,0.4,2026-01-02,745,N,h,2.0,290,5.5,night\n20.10001,75.2,330,0.4,0.4,2026-01-02,745,N,x,2.0,290,bad,\n")
    rows = sorted((r.asDict() for r in satellite.read_csv(spark, str(tmp_path / "a.csv"), "VIIRS_SNPP_NRT").collect()), key=lambda r: r["lat"])
    assert len(rows) == 2 and (rows[0]["confidence"], rows[0]["daynight"], rows[0]["frp"], rows[0]["acq"]) == ("high", "N", 5.5, dt.datetime(2026, 1, 2, 7, 45))
    assert (rows[1]["confidence"], rows[1]["daynight"], rows[1]["frp"]) == ("nominal", "D", 0.0)
    import hashlib

    assert rows[0]["detection_id"] == hashlib.sha1(b"VIIRS_SNPP_NRT|20.10000|75.20000|2026-01-02T07:45:00+00:00").hexdigest()[:20]
    (tmp_path / "b.csv").write_text("<html>busy</html>\n")
    (tmp_path / "c.csv").write_text(CSV)
    with pytest.raises(satellite.UnexpectedPayload):
        satellite.read_csv(spark, str(tmp_path / "b.csv"), "VIIRS_NOAA20_NRT")
    got, errors = satellite.read_products(spark, {"VIIRS_SNPP_NRT": str(tmp_path / "a.csv"), "VIIRS_NOAA20_NRT": str(tmp_path / "b.csv"), "VIIRS_NOAA21_NRT": str(tmp_path / "c.csv")})
    assert got.count() == 2 and len(errors) == 1 and dict(got.dtypes)["frp"] == "double"
    satellite.write_archive(got, str(tmp_path / "arch"))
    satellite.write_archive(got, str(tmp_path / "arch"))
    assert satellite.read_archive(spark, [str(tmp_path / "arch")], "2026-01-01", "2026-01-03").count() == 2


def test_loaders(spark):
    plants = spark.createDataFrame([("India", "Coal", "I1", "P", "20.5", "75.5", "500"), ("India", "Solar", "I2", "S", "20", "75", "5"), ("Peru", "Gas", "I3", "X", "20", "75", "5"), ("IND", "Gas", "I4", "B", "bad", "75", "5")], "country string, primary_fuel string, gppd_idnr string, name string, latitude string, longitude string, capacity_mw string")
    (p,) = registries.power_plants(plants).collect()
    assert (p["source_id"], p["kind"], p["radius_m"], p["capacity_mw"]) == ("I1", "power_thermal", 1500.0, 500.0)
    units = spark.createDataFrame([("A", "21.12, 83.45", "India", "construction", "10", "Unit 2"), ("A", "21.12, 83.45", "India", "Operating", "20", "Unit 1"), ("A", "21.12, 83.45", "India", "retired", "99", "Unit 0"), ("B", "22,84", "India", "", None, "Other")], "`Plant ID` string, Coordinates string, `Country/Area` string, Status string, `Capacity` string, Name string")
    got = {r["source_id"]: r for r in registries.tracker(units, "steel").collect()}
    assert (got["steel:A"]["capacity_mw"], got["steel:A"]["status"], got["steel:A"]["name"], got["steel:A"]["lat"]) == (30.0, "operating", "Unit 1", 21.12) and got["steel:B"]["capacity_mw"] is None
    flares = spark.createDataFrame([(20.0, 75.0, 1800.0, f"2026-01-0{i}") for i in range(1, 6)] + [(21.0, 75.0, 900.0, f"2026-01-0{i}") for i in range(1, 9)], "Lat_GMTCO double, Lon_GMTCO double, Temp_BB double, Date_Mscan string")
    (v,) = registries.flare_nights(flares).collect()
    assert v["status"] == "5 nights" and v["kind"] == "gas_flare"
    volumes = spark.createDataFrame([(1, 20.0, 75.0, "India", 2022, 0.5), (1, 20.0, 75.0, "India", 2023, 0.0), (2, 20.0, 76.0, "India", 2021, 0.1), (3, 20.0, 76.0, "Iraq", 2021, 0.1)], "id long, lat double, lon double, Country string, Year int, BCM double")
    assert {r["source_id"]: r["status"] for r in registries.flare_volumes(volumes).collect()} == {"ggfr:1": "flaring in 2023: 0.0000 bcm; 1 of 3 years", "ggfr:2": "flaring in 2021: 0.1000 bcm; 1 of 3 years"}
    assert registries.discovered(["/x/Global-Coal-Plant-Tracker.xlsx", "/x/global_power_plant_database.csv", "/x/nightfire_2020.csv", "/x/readme.csv", "/x/a.txt", "/x/flare-volume.xlsx"])["gem"] == [("/x/Global-Coal-Plant-Tracker.xlsx", "coal_plant")]


def test_map_elements(spark, tmp_path):
    pt = lambda *p: [{"lat": y, "lon": x} for x, y in p]
    way = lambda role, *p: {"type": "way", "role": role, "geometry": pt(*p)}
    elements = [
        {"type": "node", "id": 1, "lat": 20.0, "lon": 75.0, "tags": {"name": "N"}}, {"type": "way", "id": 2, "geometry": pt((0, 0), (1, 0), (1, 1), (0, 0))}, {"type": "way", "id": 3, "geometry": pt((0, 0), (1, 0))},
        {"type": "relation", "id": 4, "members": [way("outer", (0, 0), (4, 0), (4, 4)), way("outer", (0, 0), (0, 4), (4, 4)), way("inner", (1, 1), (2, 1), (2, 2), (1, 1))]}, {"type": "relation", "id": 5, "center": {"lat": 1.0, "lon": 2.0}}, {"type": "relation", "id": 6}, {"type": "node", "id": 7},
    ]
    (tmp_path / "e.json").write_text(json.dumps({"elements": elements}))
    got = {r["osm_id"]: r for r in registries.map_elements(spark, str(tmp_path / "e.json")).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and len(got[2]["rings"]) == 1 and got[3]["rings"] is None and len(got[4]["rings"]) == 2
    assert got[4]["geometry_source"] == "relation_reconstructed" and got[5]["geometry_source"] == "relation_center_fallback"


@pytest.mark.parametrize("tags,kind", [
    ({"man_made": "flare"}, "gas_flare"), ({"power": "plant", "plant:source": "solar"}, None), ({"power": "plant", "plant:source": "coal;solar"}, "power_thermal"), ({"power": "generator"}, "power_thermal"), ({"power": "plant", "plant:source": "magic"}, None),
    ({"industrial": "Steel"}, "steel_metal"), ({"landuse": "quarry"}, "mining_quarry"), ({"man_made": "works"}, "factory_generic"), ({"landuse": "forest"}, None), ({}, None),
])
def test_kinds(spark, tags, kind):
    assert spark.createDataFrame([(tags,)], "t map<string,string>").select(facilities.thermal_kind(F.col("t"))).first()[0] == kind


FAC = "source string, source_id string, name string, kind string, lat double, lon double, radius_m double, capacity_mw double, status string, fuel string, footprint_area double, footprint string"


def fac(source, sid, kind, lat, lon, cap=None, name=None, area=0.0, foot=None):
    return (source, sid, name, kind, lat, lon, 1500.0, cap, None, None, area, foot)


def test_facility_merge(spark):
    rows = [
        fac("osm", "a", "power_thermal", 20.0, 75.0, None, "Osm", 2.0, "big"), fac("wri_gppd", "b", "power_thermal", 20.001, 75.0, 100.0, " "), fac("gem", "c", "power_thermal", 20.002, 75.0, 60.0, "Gem", 1.0, "small"), fac("gem", "d", "power_thermal", 20.002, 75.0001, 70.0),
        fac("osm", "e", "power_thermal", 20.0078, 75.0), fac("osm", "f", "cement", 20.001, 75.001), fac("osm", "g", "factory_generic", 20.001, 75.0),
    ]
    random.Random(3).shuffle(rows)
    out, links = facilities.merge(spark.createDataFrame(rows, FAC))
    got = sorted((r.asDict() for r in out.collect()), key=lambda r: (-r["source_count"], r["kind"], r["lat"]))
    assert links.count() == 7 and len(got) == 3
    assert (got[0]["sources"], got[0]["capacity_mw"], got[0]["name"], got[0]["footprint"], got[0]["primary_source"]) == ("gem,wri_gppd,osm", 130.0, "Gem", "big", "gem")
    again, _ = facilities.merge(spark.createDataFrame(sorted(rows, key=str), FAC))
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


REC = "id long, name string, industry string, address string, state string, district string, lat double, lon double"


def test_matching(spark):
    left = spark.createDataFrame([(1, "alpha steel", "factory", None, "x", "d1", 20.0, 75.0), (2, "beta cement", None, None, "x", "D1 ", 20.0, 76.0), (3, "zeta", None, None, "x", None, 10.0, 70.0)], REC)
    right = spark.createDataFrame([(10, "steel alpha", "works", None, "x", "d1", 20.0, 75.0), (11, "beta cement", None, None, "x", "d2", 20.01, 76.0), (12, "gamma", None, None, "x", "", 20.4, 75.4)], REC)
    pairs = lambda d: sorted(map(tuple, d.select("left_id", "right_id").collect()))
    assert pairs(matching.block_district(left, right)) == [(1, 10), (2, 10)]
    assert pairs(matching.block_radius(left, right)) == [(1, 10), (2, 11)]
    assert pairs(matching.block_prefix(left, right)) == [(2, 11)]
    assert (1, 12) in pairs(matching.block_grid(left, right)) and (3, 10) not in pairs(matching.block_geohash(left, right))
    both = [matching.block_radius(left, right), matching.block_prefix(left, right)]
    assert pairs(matching.combined(both)) == [(1, 10), (2, 11)] and pairs(matching.combined(both, at_least=2)) == [(2, 11)] and len(pairs(matching.combined([matching.block_grid(left, right)], per_left=1))) == 2
    s = {r["left_id"]: r for r in matching.scored(matching.combined(both), left, right).collect()}
    assert (s[1]["match_score"], s[1]["match_confidence"], s[1]["match_method"]) == (pytest.approx(1.0), "automatic_match", "industry+name+spatial")
    assert s[2]["match_confidence"] == "non_match" or s[2]["match_score"] < 0.85
    rec = spark.createDataFrame([(1,), (2,), (10,), (11,)], "key long")
    c = matching.clusters(rec, matching.scored(matching.combined(both), left, right))
    assert {r["key"]: r["cluster"] for r in c.collect()} == {1: 1, 10: 1, 2: 2, 11: 11}
    got = {r["cluster"]: r["site_id"] for r in matching.site_ids(c, spark.createDataFrame([(10, "old")], "source_key long, site_id string")).collect()}
    assert got[1] == "old" and len(got[2]) == 36
    assert {r["cluster"]: r["methods"] for r in matching.match_fields(c, matching.scored(matching.combined(both), left, right)).collect()} == {1: "industry+name+spatial"}


def test_cut_blocks_give_the_same_limit(spark, monkeypatch):
    """Each strategy cut to the lowest ids beforehand, against all pairs cut afterwards."""
    rng = random.Random(9)
    rows = lambda n, at: spark.createDataFrame([(at + i, f"n{rng.randrange(4)} x", f"i{rng.randrange(3)}", f"d{rng.randrange(4)}", 20 + rng.random(), 75 + rng.random()) for i in range(n)], "id long, name string, industry string, district string, lat double, lon double")
    left, right = rows(40, 0), rows(90, 1000)
    monkeypatch.setattr(matching, "PARTS", 3)
    blocks = lambda cap: [matching.block_district(left, right, cap), matching.block_grid(left, right, 0.2, cap), matching.block_industry(left, right, cap), matching.block_prefix(left, right, cap=cap)]
    for limit in (1, 5, 12):
        assert sorted(matching.combined(blocks(limit), per_left=limit).collect()) == sorted(matching.combined(blocks(None), per_left=limit).collect())


def test_near_duplicates(spark):
    rows = [(1, "alpha steel works", None, None, "x", "d", 20.0, 75.0), (2, "alpha steel works", "cement", None, "x", "d", 20.0001, 75.0), (3, "alpha steel work", None, None, "x", "d", 20.0002, 75.0), (4, "alpha stone", None, None, "x", "d", 20.0003, 75.0), (5, "alpha steel works", None, None, "y", "d", 20.0, 75.0), (6, "alpha steel works", None, None, "x", "d", 21.0, 75.0)]
    got = {r["id"]: (r["duplicate_of"], r["flagged"]) for r in dedupe.near_duplicates(spark.createDataFrame(rows, REC), "id").collect()}
    assert got[2][0] == 1 and got[3][0] == 1 and got[5] == (None, False) and got[6] == (None, False)
    kept, gone = dedupe.keep_first(spark.createDataFrame(rows, REC), ["name"], "id")
    assert kept.count() == 3 and {r["group_size"] for r in gone.collect()} == {4}
    groups = {r["id"]: r["group"] for r in dedupe.probable_groups(spark.createDataFrame(rows, REC), "id").collect()}
    assert groups[2] == 1 and groups[3] == 1 and groups[6] == 6


SNAP = "osm_id long, osm_version int, source_timestamp timestamp, name string, raw_tags map<string,string>, geometry string, first_seen date, last_seen date, operational_status string"


def test_refresh(spark):
    d, t = dt.date, dt.datetime
    old = [(1, 1, t(2025, 1, 1), "a", {"k": "1"}, "g1", d(2025, 1, 1), d(2025, 1, 1), "mapped"), (2, 1, t(2025, 1, 1), "b", {}, "g", d(2025, 1, 1), d(2025, 1, 1), "mapped"), (3, 1, t(2025, 1, 1), "c", {}, "g", d(2025, 1, 1), d(2025, 1, 1), "mapped"), (5, None, t(2025, 1, 1), "e", {}, "g", d(2025, 1, 1), d(2025, 1, 1), "mapped")]
    new = [(1, 2, t(2025, 2, 1), "A", {"k": "2"}, "g2", None, None, None), (2, 1, t(2025, 3, 1), "b", {}, "g", None, None, None), (4, 1, t(2025, 2, 1), "d", {}, "g", None, None, "mapped"), (5, None, t(2025, 2, 1), "e", {}, "g9", None, None, None)]
    o, n = spark.createDataFrame(old, SNAP), spark.createDataFrame(new, SNAP)
    got = {r["osm_id"]: r for r in snapshots.refresh(o, n, ["osm_id"], "osm_version", "source_timestamp", "2025-03-01").collect()}
    assert {k: r["change"] for k, r in got.items()} == {1: "updated", 2: "unchanged", 3: "removed", 4: "new", 5: "updated"}
    assert (got[1]["geometry"], got[1]["name"], got[1]["raw_tags"]) == ("g2", "a", {"k": "2"}) and got[3]["operational_status"] == "removed" and got[3]["last_seen"] == d(2025, 1, 1) and got[2]["last_seen"] == d(2025, 3, 1)
    assert snapshots.refresh(o, n.limit(0), ["osm_id"], "osm_version", "source_timestamp", "2025-03-01").count() == 4


def test_temporal_merge(spark):
    schema = "k string, first_seen date, last_seen date, name string, ids array<string>"
    a = spark.createDataFrame([("x", dt.date(2025, 1, 2), dt.date(2025, 1, 3), "old", ["1", "2"]), (None, None, None, "n", None)], schema)
    b = spark.createDataFrame([("x", dt.date(2025, 2, 2), dt.date(2025, 2, 3), None, ["2", "3"]), (None, None, dt.date(2025, 1, 1), None, None)], schema)
    got = {r["k"]: r for r in snapshots.temporal_merge(a, b, ["k"], ("ids",)).collect()}
    assert (got["x"]["first_seen"], got["x"]["last_seen"], got["x"]["name"], got["x"]["ids"]) == (dt.date(2025, 1, 2), dt.date(2025, 2, 3), "old", ["1", "2", "3"]) and len(got) == 2 and got[None]["name"] == "n"


def test_synchronise(spark):
    schema = "k long, content_hash string, v int"
    stage = spark.createDataFrame([(1, "a", 1), (2, "b2", 2), (4, "d", 4), (5, None, 5)], schema)
    master = spark.createDataFrame([(1, "a", 1, True), (2, "b", 0, True), (3, "c", 3, True), (4, "d", 4, False), (5, None, 5, True)], schema + ", is_active boolean")
    new, counts = snapshots.synchronise(stage, master, "k")
    assert counts == {"keep": 2, "update": 2, "deactivate": 1}
    got = {r["k"]: (r["v"], r["is_active"]) for r in new.collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, False), 4: (4, True), 5: (5, True)}
    _, again = snapshots.synchronise(stage, new, "k")
    assert again == {"keep": 5}
    big = spark.range(300).select(F.col("id").alias("k"), F.lit("h").alias("content_hash"), F.lit(1).alias("v"), F.lit(True).alias("is_active"))
    with pytest.raises(snapshots.TooManyRemovals):
        snapshots.synchronise(big.filter("k < 200").drop("is_active"), big, "k")


def test_labels(spark):
    support = [dict(region=r, label=c, before=b, after=a) for r, c, b, a in [("a", "x", 10, 5), ("a", "y", 10, 5), ("b", "x", 20, 9), ("b", "y", 20, 9), ("c", "x", 1, 0), ("c", "y", 1, 0)]]
    assert labels.held_out(support, 100) == ["a", "b"] or labels.held_out(support, 100) == ["b"]
    u = spark.createDataFrame([("Haryāna", 76.0, 900.0, 3100.0, 0.2, 0.01, 0.8, 0.1, 11), ("Uttar Pradesh", 80.0, 5000.0, 5000.0, 0.0, 0.0, 0.9, 0.75, 11), (None, 76.0, 5000.0, 3000.0, None, 0.01, 0.9, 0.9, 11)], "state string, lon double, distance_to_authoritative_facility_m double, distance_to_any_facility_m double, facility_baseline_active_fraction double, cell_baseline_active_fraction double, lc_crop double, lc_woody double, window_month int")
    got = [tuple(r[f"is_{c}"] for c in labels.LABELS) for r in labels.apply_rules(u).collect()]
    assert got == [(True, True, False), (False, False, True), (False, False, False)]


def test_metrics(spark):
    d = spark.createDataFrame([("a", "a", 0.9, 1), ("a", "b", 0.8, 1), ("b", "b", 0.8, 0), ("c", "a", 0.1, 0)], "t string, p string, s double, y int")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in evaluation.per_class(d, "t", "p").collect()}
    assert got == {"a": (0.5, 0.5, 0.5), "b": (0.5, 1.0, pytest.approx(2 / 3)), "c": (0.0, 0.0, 0.0)}
    assert evaluation.auc(d, "s", "y").first()[0] == pytest.approx(3.5 / 4)
    assert evaluation.threshold(d, "s", 2).first()[0] == 0.9
    low, high = evaluation.bootstrap(d, "t", "t", "p", 100).first()
    assert 0 <= low <= high <= 1


def test_imagery(spark):
    chip = lambda nir, swir: ([nir] * 300, [swir] * 300)
    d = spark.createDataFrame([(1, *chip(0.4, 0.1), *chip(0.1, 0.4)), (2, *chip(0.4, 0.1), *chip(0.4, 0.1)), (3, *chip(0.01, 0.01), *chip(0.4, 0.1))], "k long, nir_before array<double>, swir_before array<double>, nir_after array<double>, swir_after array<double>")
    got = {r["k"]: r for r in imagery.dnbr_summary(d).collect()}
    assert got[1]["dnbr_mean"] == pytest.approx(1.2) and got[1]["severity"] == "high severity" and got[2]["severity"] == "unburned / no change" and got[3]["dnbr_mean"] is None and got[3]["valid_fraction"] == 0


def test_government_records(spark):
    d = spark.createDataFrame([("Alpha", "20.5", "75.1"), ("Beta", None, "75"), ("Gamma", "200", "75")], "FacilityName string, Latitude string, `Lng` string")
    ok, bad = quality.government_records(d, "gov")
    (r,) = ok.collect()
    assert (r["facility_name"], r["lat"], r["lon"]) == ("Alpha", 20.5, 75.1) and json.loads(r["raw_record"])["latitude"] == "20.5"
    assert sorted(x["reason"] for x in bad.collect()) == ["invalid coordinates", "missing coordinates"]


def test_publish_is_atomic(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert sinks.current(spark, root) is None
    sinks.publish(spark.range(3), root, "v1")
    sinks.publish(spark.range(5), root, "v2")
    spark.range(9).write.parquet(f"{root}/v3/data")  # written, not committed
    assert sinks.current(spark, root).count() == 5
    assert sinks.insert_new(spark.range(4).toDF("k"), str(tmp_path / "t"), "k") == {"offered": 4, "inserted": 4}
    assert sinks.insert_new(spark.range(6).toDF("k"), str(tmp_path / "t"), "k") == {"offered": 6, "inserted": 2}


def test_stream_dedupe_equals_the_batch_fold(spark, tmp_path):
    from emberline.operators import alerts

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t, rng = dt.datetime(2026, 1, 1), random.Random(6)
    events = sorted((f"f{rng.randrange(3)}", t + dt.timedelta(minutes=rng.randrange(6000))) for _ in range(80))
    df = spark.createDataFrame(sorted(set(events), key=lambda e: e[1]), "facility_key string, ts timestamp")
    df.repartitionByRange(1, "ts").write.parquet(str(tmp_path / "in"))
    q = live.deduped(live.read_detections(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("dedup").select("facility_key", "ts", "created").collect()))
    assert got == sorted(map(tuple, alerts.dedupe(df).select("facility_key", "ts", "created").collect()))


def test_freshness_and_export(spark):
    assert [r[0] for r in serving.csv_export(spark.createDataFrame([("=1+1",), ("ok",), (None,)], "c string")).collect()] == ["'=1+1", "ok", None]
    with pytest.raises(ValueError):
        serving.thermal(spark.range(1), serving.ThermalFilters(classes=("nonsense",)))
