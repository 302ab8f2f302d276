"""Operators that work in rounds or by buckets, against plain loops, on inputs that take every branch."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from emberline import staging
from emberline.functions import geo
from emberline.operators import alerts, dedupe, evaluation, graph, learning, ordering, snapshots, spatial
from emberline.plans import serving
from emberline.sources import satellite


def haversine(p, q):
    a, b, c, d = map(math.radians, (*p, *q))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(min(h, 1)))


def some_edges(seed):
    rng = random.Random(seed)
    return [(i, i + 1) for i in range(100, 160)] + [(7, 500 + i) for i in range(60)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)] + [(3, 3), (2, 1), (1, 2)]


@pytest.mark.parametrize("bound", [0, 40, 1 << 20])
def test_components_in_rounds(spark, monkeypatch, bound):
    """bound: edges that one task may take; none means rounds down to the last edge."""
    monkeypatch.setattr(graph, "TASK_EDGES", bound)
    edges = some_edges(5)
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def taken(nodes, edges):
    near = {}
    for a, b in edges:
        near.setdefault(min(a, b), set()).add(max(a, b))
    anchor = {}
    for n in sorted(nodes):
        if n not in anchor:
            anchor[n] = n
            for m in near.get(n, ()):
                anchor.setdefault(m, n)
    return anchor


@pytest.mark.parametrize("bound", [0, 30, 1 << 20])
def test_greedy_anchors_in_rounds(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "TASK_EDGES", bound)
    edges = [(min(e), max(e)) for e in some_edges(8) if e[0] != e[1] and not 100 <= e[0] < 145]
    nodes = sorted({x for e in edges for x in e} | {9999})
    got = {r["key"]: r["anchor"] for r in graph.greedy_anchors(spark.createDataFrame([(n,) for n in nodes], "key long"), spark.createDataFrame(edges, "a long, b long"), "key").collect()}
    assert got == taken(nodes, edges)


def test_near_duplicates_against_a_walk(spark):
    rng = random.Random(4)
    rows = [(i, f"n{rng.randrange(40)}", None, None, None, 20 + rng.randrange(30) / 1e4, 75 + rng.randrange(30) / 1e4) for i in range(150)]
    like = lambda a, b: F.pmod(F.xxhash64(F.least(a, b), F.greatest(a, b)), F.lit(101)).cast("double")
    df = spark.createDataFrame(rows, "id long, name string, industry string, state string, district string, lat double, lon double")
    score = {(r["a"], r["b"]): r["s"] for r in df.select(F.col("id").alias("a"), F.col("name").alias("x")).join(df.select(F.col("id").alias("b"), F.col("name").alias("y")), F.col("a") < F.col("b")).select("a", "b", like(F.col("x"), F.col("y")).alias("s")).collect()}
    at = {r[0]: r[5:] for r in rows}
    gone, flagged = {}, set()
    for (a, b), s in sorted(score.items()):
        if s >= 60 and haversine(at[a], at[b]) <= 100 and a not in gone and b not in gone:
            if s >= 85:
                gone[b] = a
            else:
                flagged |= {a, b}
    got = dedupe.near_duplicates(df, "id", remove=85, flag=60, similarity=lambda a, b: like(F.col(a), F.col(b))).collect()
    assert {r["id"]: (r["duplicate_of"], r["flagged"]) for r in got} == {i: (gone.get(i), i in flagged) for i in at}
    assert len(gone) > 5 and len(flagged) > 5


@pytest.mark.parametrize("reach", [900.0, 45_000.0, 700_000.0])
def test_distance_joins_on_the_whole_globe(spark, reach):
    """Pairs were lost beyond 60 degrees and across the date line."""
    rng = random.Random(int(reach))
    step = reach / 111_000
    points = []
    for lat in (0, 30, -59, 65, 75, -82, 88, 89.9, -89.99, 90, -90):
        for lon in (0, 100, 179.999, -179.999, -180, 180):
            for _ in range(4):
                la = max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * step))
                points.append((la, lon + rng.uniform(-1, 1) * step / max(math.cos(math.radians(la)), 0.02)))
    rows = [(i, *p) for i, p in enumerate(points)] + [(9000, None, 1.0), (9001, 1.0, None)]
    df = spark.createDataFrame(rows, "k long, lat double, lon double")
    got = spatial.pairs_within(df, df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns]), reach).select("k", "r_k").collect()
    want = {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if haversine(p, q) <= reach}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) > len(points)


def test_nearest_anywhere(spark):
    rng = random.Random(8)
    fac = [(i, 8 + rng.random() * 25, 69 + rng.random() * 25) for i in range(60)] + [(100, -75.0, 179.5), (101, 89.5, 10.0), (102, 8.5, 69.5), (103, 8.5, 69.5)]
    pts = [(i, 8 + rng.random() * 25, 69 + rng.random() * 25) for i in range(60)] + [(1000 + i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(150)] + [(2000, -76.0, -179.9), (2001, 90.0, 0.0), (2002, -90.0, 0.0), (2003, 8.5, 69.5), (2004, 8.5, 69.5)]
    kinds = "long, lat double, lon double"
    df, f = spark.createDataFrame([*pts, (3000, None, 1.0)], f"k {kinds}"), spark.createDataFrame([*fac, (500, None, None)], f"ref {kinds}")
    got = {r["k"]: (r["ref"], r["distance_m"]) for r in spatial.nearest_facility(df, f, "k").collect()}
    assert got.pop(3000) == (None, None) and len(got) == len(pts)
    for k, *p in pts:
        d, ref = min((haversine(p, q), r) for r, *q in fac)
        assert got[k][1] == pytest.approx(d, abs=1e-3) and (got[k][0] == ref or abs(haversine(p, next(q for r, *q in fac if r == got[k][0])) - d) < 1e-3)
    assert got[2003][0] == 102
    assert {r["ref"] for r in spatial.nearest_facility(df, f.limit(0), "k").collect()} == {None}


@pytest.mark.parametrize("at_limit_new", [True, False])
def test_alerts_against_a_fold(spark, at_limit_new):
    """A busy facility, repeated times, missing times and keys; other columns stay."""
    rng, t = random.Random(3), dt.datetime(2026, 1, 1)
    rows = [("busy", t + dt.timedelta(minutes=30 * rng.randrange(900)), i) for i in range(700)] + [(f"f{i % 9}", t + dt.timedelta(hours=rng.randrange(200)), 1000 + i) for i in range(120)] + [("busy", None, 5000), (None, t, 5001), (None, t, 5002)]
    last, want = {}, {}
    for k, ts, n in sorted((r for r in rows if r[1]), key=lambda r: (r[0] or "", r[1], r[2])):
        gap = None if k not in last else ts - last[k]
        limit = dt.timedelta(hours=6)
        want[n] = gap is None or (gap >= limit if at_limit_new else gap > limit)
        if want[n]:
            last[k] = ts
    want[5000] = False
    df = spark.createDataFrame(rows, "facility_key string, ts timestamp, n long").withColumn("frp", F.col("n") * 1.5).repartition(5)
    got = alerts.dedupe(df, at_limit_new=at_limit_new)
    assert got.columns == [*df.columns, "created"]
    assert {r["n"]: r["created"] for r in got.collect()} == want and all(r["frp"] == r["n"] * 1.5 for r in got.collect())
    assert alerts.dedupe(df.limit(0)).count() == 0


def test_csv_columns_go_by_each_files_header(spark, tmp_path):
    """The header of one file was forced on all: longitudes became latitudes."""
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.csv").write_text("latitude,longitude,acq_date,acq_time,frp,confidence,daynight\n20.5,75.25,2026-01-02,745,5.5,h,N\n")
    (tmp_path / "f/b.csv").write_text('"longitude","latitude",frp,acq_date,acq_time,extra,confidence\n71.5,11.5,6.5,2026-01-02,2359,zz,l\n')
    got = {(r["lat"], r["lon"], r["frp"], r["confidence"], r["acq"].hour) for r in satellite.read_csv(spark, str(tmp_path / "f"), "VIIRS_SNPP_NRT").collect()}
    assert got == {(20.5, 75.25, 5.5, "high", 7), (11.5, 71.5, 6.5, "low", 23)}
    (tmp_path / "f/c.csv").write_text("<html>busy</html>\n")
    with pytest.raises(satellite.UnexpectedPayload):
        satellite.read_csv(spark, str(tmp_path / "f"), "VIIRS_SNPP_NRT")


def test_repeated_keys_on_one_side_of_a_merge(spark):
    schema = "k string, first_seen date, last_seen date, name string"
    old = [("x", dt.date(2025, 1, 1), dt.date(2025, 1, d), n) for d, n in ((3, "c"), (5, "b"), (5, "a"), (4, None))]
    new = [("x", dt.date(2025, 2, 1), dt.date(2025, 2, 1), None), ("y", dt.date(2025, 2, 1), dt.date(2025, 2, d := 2), "p"), ("y", dt.date(2025, 2, 1), dt.date(2025, 2, d), "q")]
    for seed in range(3):
        shuffle = lambda rows: spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), schema).repartition(3)
        got = {r["k"]: (r["name"], r["last_seen"].day) for r in snapshots.temporal_merge(shuffle(old), shuffle(new), ["k"]).collect()}
        assert got == {"x": ("b", 1), "y": ("q", 2)}


def test_series_keeps_its_ends(spark):
    d = spark.range(1000).withColumn("t", F.col("id") * 3)
    got = sorted(r["t"] for r in serving.downsampled(d.repartition(7), "t", 11).collect())
    assert got[0] == 0 and got[-1] == 2997 and len(got) == 11
    assert serving.downsampled(d.limit(5), "t", 11).count() == 5
    ranks = ordering.ranked(d.repartition(7), ["t"], "rank").collect()
    assert all(r["rank"] == r["id"] for r in ranks)


def test_importance_of_the_only_feature_that_counts(spark):
    rng = random.Random(1)
    rows = [(i, "ab"[i % 2], f"r{i % 7}", float(i % 2), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, label string, region string, x double, y double")
    model = learning.train(df, ["x", "y"], ["a", "b"], "label", "region", rounds=2)
    drop = {r["feature"]: r["drop"] for r in learning.permutation_importance(model, df, "label", "k", rounds=3).collect()}
    assert 0.35 < drop["x"] < 0.65 and abs(drop["y"]) < 0.01


def test_effects_against_all_orders(spark):
    """With two features the mean over both orders is known: half of each way in which a feature can join."""
    rows = [(i, "ab"[i % 2], f"r{i % 7}", float(i % 2), float(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, label string, region string, x double, y double")
    model = learning.train(df, ["x", "y"], ["a", "b"], "label", "region", rounds=2)
    one, back = df.filter("k = 7"), df.filter("k = 4")
    p = lambda x, y: learning.score(model, one.withColumns({"x": F.lit(x), "y": F.lit(y)})).first()["model_scores"]["b"]
    got = {r["feature"]: r["effect"] for r in learning.shapley(model, one, back, "k", permutations=40).collect()}
    assert sum(got.values()) == pytest.approx(p(1.0, 1.0) - p(0.0, 1.0), abs=1e-9)
    assert got["x"] > 0.3 and got["x"] == pytest.approx(p(1.0, 1.0) - p(0.0, 1.0), abs=1e-6) and got["y"] == pytest.approx(0, abs=1e-6)


def test_bootstrap_interval(spark):
    """All right: both ends are 1. Half right in every block: the interval holds the mean."""
    rows = [(i, i % 25, "a", "a", "a" if i % 2 else "b") for i in range(500)]
    df = spark.createDataFrame(rows, "i long, cell long, t string, p string, q string")
    assert tuple(evaluation.bootstrap(df, "cell", "t", "p", 100).first()) == (1.0, 1.0)
    low, high = evaluation.bootstrap(df, "cell", "t", "q", 200).first()
    assert low <= high and high < 0.9


def test_shared_folder_is_refused_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())
