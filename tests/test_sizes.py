"""Queries whose work grew with the square of a group: results against brute force, and how many rows the plan makes."""

import datetime as dt
import random
from collections import Counter

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__

SMALL = "/root/testdata/sf0.01"


def twin(spark, name):
    assert oracle.differences(spark, oracle.duck(SMALL), __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], SMALL) is None


def operator_rows(df, metric="numOutputRows"):
    """Rows that each operator of the plan made, or wrote for a shuffle, in one run."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], [0]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        found = node.metrics().get(metric)
        if found.isDefined():
            rows.append(found.get().value())
    return rows


def test_tick_counts_without_pairs(spark):
    """Repeated and missing ids count as in the pairs, which the plan does not make."""
    from emberline.streaming import live

    rng = random.Random(5)
    rows = [(None if i % 17 == 0 else rng.randrange(150), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(20 * 1440))) for i in range(200)] + [(7, None)]
    det = spark.createDataFrame(rows, "detection_id long, acq timestamp")
    shown = [(r["tick"], r["detection_id"]) for r in live.replay_ticks(det, "2024-01-10", "2024-01-18", 45).collect() if r["detection_id"] is not None]
    first = {}
    for tick, i in shown:
        first[i] = min(tick, first.get(i, tick))
    visible, new = Counter(t for t, _ in shown), Counter(t for t, i in shown if first[i] == t)
    got = live.tick_counts(det, "2024-01-10", "2024-01-18", 45)
    assert {r["tick"]: (r["visible"], r["new"]) for r in got.collect()} == {t: (n, new[t]) for t, n in visible.items()}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    twin(spark, "replay_ticks")


RECORDS = "id long, name string, industry string, district string, lat double, lon double"


def records(rng, n, at, ids):
    """Ids repeat, in equal and unequal records; every column has missing and empty values."""
    pick = lambda c, k: rng.choice([None, "", " ", *[f"{c}{i}" for i in range(k)], f" {c.upper()}0 "])
    place = lambda a: None if rng.random() < 0.05 else a + rng.randrange(12) / 4
    rows = [(None if rng.random() < 0.05 else at + rng.randrange(ids), pick("n", 4), pick("i", 3), pick("d", 4), place(-1), place(179)) for _ in range(n)]
    return rows + rows[:5]


def test_agreeing_pairs(spark):
    """Equal to the strategies counted over all of their pairs, without making those for ids of one record."""
    from emberline.operators import matching

    rng = random.Random(3)
    left, right = (spark.createDataFrame(records(rng, 60, at, 50), RECORDS) for at in (0, 1000))
    want = matching.combined([matching.block_district(left, right), matching.block_grid(left, right), matching.block_industry(left, right)], at_least=2, per_left=None)
    got = sorted(map(tuple, matching.agreeing(left, right).collect()), key=repr)
    assert got == sorted(map(tuple, want.collect()), key=repr) and {n for _, _, n in got} == {2, 3}
    twin(spark, "block_intersection")
    plan = __spark_entry__.queries()["block_intersection"](spark, SMALL)
    assert max(operator_rows(plan)) < 20_000  # 1,000 by 1,000 records: 9,486 pairs, of 214,000 with one strategy or more


def named(rng, n, names):
    """Records at few places, with missing names and places."""
    return [(i, rng.choice(names), None, None, None if i % 13 == 0 else 20 + rng.randrange(9) / 2e3, 75 + rng.randrange(9) / 2e3) for i in range(n)]


NAMES = [None, "", "red bolt", "Red  bolt", "red rod", "blue rod", "blue rods", "old anvil", "!"]


@pytest.mark.parametrize("kinds", [1024, 2])
def test_trigram_pairs(spark, monkeypatch, kinds):
    """Names of few kinds and of many against the pairs of all rows; no pair of rows is made that is not in reach."""
    from emberline.functions import text
    from emberline.operators import dedupe, spatial

    monkeypatch.setattr(text, "KINDS", kinds)
    df = spark.createDataFrame(named(random.Random(8), 120, NAMES), RECORDS)
    every = spatial.pairs_within(df, df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns]), 300.0).filter("id < r_id")
    want = every.withColumn("s", text.trigram_similarity(F.col("name"), F.col("r_name"))).filter("s >= 0.3").select("id", "r_id", "distance_m", "s")
    assert sorted(dedupe.trigram_pairs(df, "id", 300.0, 0.3).collect()) == sorted(want.collect()) != []
    if kinds == 1024:
        twin(spark, "trigram_similarity")
        plan = __spark_entry__.queries()["trigram_similarity"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "flatten" not in plan  # trigrams are taken of the 64 kinds of names, not of the pairs


def test_radius_by_place(spark):
    """Many records at one place: none are joined that are out of reach, and missing places match nothing."""
    from emberline.operators import matching

    rows = lambda at, lat: spark.createDataFrame([(at + i, "x", "y", "z", None if i == 0 else lat, 75.0) for i in range(200)], RECORDS)
    left = rows(0, 20.0)
    far = matching.block_radius(left, rows(1000, 20.0065), 600.0)
    assert far.count() == 0 and max(operator_rows(far)) < 2_000
    near = matching.block_radius(left, rows(1000, 20.005), 600.0)
    assert sorted(map(tuple, near.collect())) == [(i, 1000 + j) for i in range(1, 200) for j in range(1, 200)]
    twin(spark, "block_radius")


def test_pairs_by_place_shuffle_blocks(spark):
    """Rows are not shuffled with each place in reach (32,400 here), but in blocks for the nine buckets around."""
    from emberline.operators import matching

    rows = lambda at: spark.createDataFrame([(at + i, "x", "y", "z", 20.0 + i % 9 / 1e4, 75.0 + i // 9 % 9 / 1e4) for i in range(400)], RECORDS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = matching.block_radius(rows(0), rows(1000), 600.0)
        assert sum(operator_rows(pairs, "shuffleRecordsWritten")) < 8_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(r) for r in pairs.collect()} == {(i, 1000 + j) for i in range(400) for j in range(400)} and pairs.count() == 160_000


def test_pairs_of_one_place_in_many_tasks(spark, monkeypatch):
    """The rows of one place, with repeated and missing ids, in blocks and parts: each pair once, and made in many tasks."""
    from emberline.operators import matching, spatial

    monkeypatch.setattr(spatial, "PLACE_BLOCK", 8, raising=False)
    ids = lambda at: [None if i % 50 == 0 else at + i % 190 for i in range(200)]
    at = lambda i: (30.0, -0.0) if i < 5 else (20.0, None) if i == 5 else (20.0, 75.0)
    rows = lambda k: spark.createDataFrame([(n, "x", "y", "z", *at(i)) for i, n in enumerate(ids(k))], RECORDS)
    pairs = matching.block_radius(rows(0), rows(1000), 600.0)
    want = [(a, b) for i, a in enumerate(ids(0)) for j, b in enumerate(ids(1000)) if at(i) == at(j) != (20.0, None)]
    assert sorted(map(tuple, pairs.collect()), key=repr) == sorted(want, key=repr)
    made = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(made) > 8 and max(made) < sum(made) / 4


@pytest.mark.parametrize("kinds", [1024, 2])
def test_scores_by_kinds_of_texts(spark, monkeypatch, kinds):
    """Pairs by place and texts by kinds against pairs looked up by ids and texts scored pair by pair."""
    from emberline.functions import text
    from emberline.operators import matching

    rng = random.Random(2)
    rows = lambda at: spark.createDataFrame([(at + i, rng.choice(NAMES), rng.choice([None, "", "works", "Plant", "plant", "mine"]), "d", lat, lon) for i, _, _, _, lat, lon in named(rng, 70, NAMES)], RECORDS)
    left, right, w = rows(0), rows(1000), matching.Weights(max_distance_m=250.0)
    columns = ["left_id", "right_id", "match_score", "match_confidence", "match_method", "candidate_id", "distance_m", "name_score", "industry_score", "address_score"]
    with monkeypatch.context() as m:
        m.setattr(text, "KINDS", 0)
        want = sorted(matching.scored(matching.block_radius(left, right, 300.0), left, right, w).select(columns).collect())
    monkeypatch.setattr(text, "KINDS", kinds)
    got = sorted(matching.scored_within(left, right, 300.0, w).select(columns).collect())
    assert got == want and len(got) > 100 and len({r["match_method"] for r in got}) > 3
    if kinds == 1024:
        for name in ("pair_scores", "pair_scores_token_set"):
            twin(spark, name)
            assert "PythonEval" not in __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString(), name


def test_rounded(spark):
    """Equal to F.round, near ties and beyond the range too."""
    from emberline.functions import text

    rng = random.Random(1)
    values = [None, float("nan"), float("inf"), 0.0, -0.0, 1e300, 0.1234565, 0.1234575, -0.1234565, 1 / 3, 2.5e-7, 5e-7, -5e-7, 1234.5678915, 12.3456785] + [rng.uniform(-2, 2) for _ in range(500)] + [rng.randrange(10**7) / 10**7 for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6).cast("string").alias("want"), text.rounded("x", 6).cast("string").alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_by_kinds(spark, monkeypatch, seed):
    """Rows taken together and names by kinds against all pairs of rows, which tests hold against a walk."""
    from emberline.functions import text
    from emberline.operators import dedupe

    rng = random.Random(seed)
    rows = [(*r[:2], rng.choice([None, None, "Mine", "mine"]), rng.choice([None, "s"]), rng.choice(["d", "d", "D", "e"]), None if r[4] is None else 20 + rng.randrange(4) / 2e3, 75 + rng.randrange(4) / 2e3) for r in named(rng, 260, NAMES)]
    df = spark.createDataFrame(rows, "id long, name string, industry string, state string, district string, lat double, lon double")
    get = lambda: sorted(map(tuple, dedupe.near_duplicates(df, "id", reach_m=120.0, remove=80.0, flag=40.0).select("id", "duplicate_of", "flagged").collect()), key=repr)
    got = get()
    monkeypatch.setattr(text, "KINDS", 2)
    assert got == get() and len(got) == 260 and {f for _, _, f in got} == {True, False} and sum(d is not None for _, d, _ in got) > 60


def test_copies_make_no_pairs(spark):
    """Three thousand copies of two records: 4.5 million pairs before, of which none is made now."""
    from emberline import staging
    from emberline.operators import dedupe

    df = spark.range(6000).selectExpr("id", "if(id % 2 = 0, 'red bolt', 'old anvil') AS name", "cast(null AS string) AS industry", "'x' AS state", "'d' AS district", "20.0D AS lat", "75.0D AS lon")
    sizes, write = {}, staging.persisted

    def persisted(d, name, *a):
        out = write(d, name, *a)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    staging.persisted = persisted
    try:
        got = dedupe.near_duplicates(df, "id").groupBy("duplicate_of").count().collect()
    finally:
        staging.persisted = write
    assert {r["duplicate_of"]: r["count"] for r in got} == {None: 2, 0: 2999, 1: 2999}
    assert max(sizes.values()) <= 6000
    twin(spark, "near_duplicate_records")


def tasks_of_pairs(spark, monkeypatch, name):
    """Number of pairs of each task that makes some, from one file of 2,000 rows, with blocks as small as the table."""
    from emberline.operators import matching

    for side, rows in (("LEFT", 16), ("RIGHT", 32)):
        monkeypatch.setattr(matching, f"{side}_BLOCK", rows, raising=False)
    twin(spark, name)
    return [r["count"] for r in __spark_entry__.queries()[name](spark, SMALL).groupBy(F.spark_partition_id().alias("task")).count().collect()]


def block_rows(spark, monkeypatch):
    """Records with repeated and missing ids, and what they are made of, with blocks of a few rows."""
    from emberline.operators import matching

    for side, rows in (("LEFT", 3), ("RIGHT", 4)):
        monkeypatch.setattr(matching, f"{side}_BLOCK", rows, raising=False)
    rng = random.Random(4)
    return [(rows := records(rng, 80, at, 70), spark.createDataFrame(rows, RECORDS)) for at in (0, 1000)]


def same_pairs(sides, pairs, same):
    (left, _), (right, _) = sides
    want = [(a[0], b[0]) for a in left for b in right if same(a, b)]
    assert sorted(map(tuple, pairs.collect()), key=repr) == sorted(want, key=repr) and {i is None for i, _ in want} == {True, False}


def test_prefix_pairs_in_many_tasks(spark, monkeypatch):
    made = tasks_of_pairs(spark, monkeypatch, "block_prefix")
    assert len(made) > 8 and max(made) < sum(made) / 8  # of eight prefixes


def test_pairs_by_blocks_of_equal_keys(spark, monkeypatch):
    """Against all pairs of rows; generated code holds the pairs of one left row and one block, not of two blocks."""
    from emberline.operators import matching

    sides = block_rows(spark, monkeypatch)
    start = lambda r: (r[1] or "").strip(" ")[:2]
    pairs = matching.block_prefix(sides[0][1], sides[1][1])
    same_pairs(sides, pairs, lambda a, b: start(a) == start(b) != "")
    plan = pairs._jdf.queryExecution().executedPlan().toString().splitlines()
    assert [line for line in plan if "Generate explode(transform(" in line and "*(" not in line]


def test_pairs_in_small_files(spark, monkeypatch, tmp_path):
    """Pages of written pairs repeat few ids: these four million took 6.4 MB before. Tasks grow in number with the pairs."""
    from emberline.operators import matching

    sides = [spark.range(n).selectExpr(f"id + {at} AS id", "'red bolt' AS name") for n, at in ((1024, 0), (4096, 10_000))]
    pairs = matching.block_prefix(*sides)
    pairs.write.parquet(str(tmp_path / "pairs"))
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.2 * 1024 * 4096
    made = spark.read.parquet(str(tmp_path / "pairs")).distinct().selectExpr("count(*)", "min(left_id)", "max(left_id)", "min(right_id)", "max(right_id)").first()
    assert tuple(made) == (1024 * 4096, 0, 1023, 10_000, 14_095)
    monkeypatch.setattr(matching, "TASK_PAIRS", 10_000)
    assert matching.block_prefix(*sides).rdd.getNumPartitions() == 420  # of 4,194,304 pairs


def test_district_pairs_in_many_tasks(spark, monkeypatch):
    from emberline.operators import matching

    made = tasks_of_pairs(spark, monkeypatch, "block_district")
    assert len(made) > 25 and max(made) < sum(made) / 8  # of 25 districts
    sides = block_rows(spark, monkeypatch)
    district = lambda r: (r[3] or "").strip(" ").lower()
    same_pairs(sides, matching.block_district(sides[0][1], sides[1][1]), lambda a, b: district(a) == district(b) != "")


def test_grid_pairs_in_many_tasks(spark, monkeypatch):
    import math

    from emberline.operators import matching

    made = tasks_of_pairs(spark, monkeypatch, "block_grid")
    assert len(made) > 25 and max(made) < sum(made) / 8
    sides = block_rows(spark, monkeypatch)
    cell = lambda r: None if None in r[4:] else [math.floor(v / 0.5) for v in r[4:]]
    near = lambda a, b: a and b and all(abs(x - y) <= 1 for x, y in zip(a, b))
    same_pairs(sides, matching.block_grid(sides[0][1], sides[1][1]), lambda a, b: near(cell(a), cell(b)))
