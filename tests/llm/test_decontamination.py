"""Contamination against a plain Smith-Waterman of every document with every item."""

import random
import re

import numpy as np
from emberline.llm import decontamination as dc
from emberline.llm import registry, stage
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def align(a, b):
    best, up = 0, [0] * (len(a) + 1)
    for y in b:
        row = [0]
        for i, x in enumerate(a):
            row.append(max(0, up[i] + (1 if x == y else -1), up[i + 1] - 1, row[i] - 1))
        up, best = row, max(best, *row)
    return best


def test_alignment_kernel():
    rng = random.Random(3)
    a = [np.array([rng.randrange(5) for _ in range(rng.randrange(1, 40))], np.int32) for _ in range(600)]
    b = [np.array([rng.randrange(5) for _ in range(rng.randrange(1, 20))], np.int32) for _ in range(600)]
    assert dc.best_scores(a, b).tolist() == [align(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def test_planted_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(800)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randrange(16, 60))) for i in range(30)] + [(98, text(400)), (99, text(2))]
    docs, want = [], set()
    for d in range(120):
        body = text(rng.randrange(5, 400))
        if d % 3 == 0:
            i, passage = items[d % 30]
            passage = [w if rng.random() > 0.08 else "new" for w in passage]
            k = rng.randrange(len(body))
            body = body[:k] + passage + body[k:]
            want.add((d, i))
        docs.append((d, " ".join(w.upper() + "," if rng.random() < 0.2 else w for w in body)))
    docs += [(500 + i, " ".join(items[5][1])) for i in range(80)] + [(700, None), (701, ""), (702, "one two"), (0, docs[0][1]), (703, " ".join(items[30][1][100:260]))]
    want |= {(500 + i, 5) for i in range(80)} | {(703, 98)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "h": F.lit("x")}).repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(100, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in dc.contaminated(df, bench).collect()}
    exact = {(d, i): align(words(t), t_i) / len(t_i) for d, t in docs for i, t_i in items if len(t_i) <= 128}
    enough = lambda pair: exact[pair] >= max(dc.MIN_SCORE, min(dc.MIN_MATCH / len(dict(items)[pair[1]]), 1))
    want = {w for w in want if w not in exact or enough(w)}
    assert len(want) > 110 and want <= set(got)
    for pair, score in exact.items():
        assert enough(pair) == (pair in got), (pair, score)
        if pair in got:
            assert abs(got[pair] - score) < 1e-9
    assert {r["doc_id"] for r in dc.keep_clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0


def test_items_that_follow_others(spark):
    """All seeds of a run are looked up: every eighth one, counted over all items, missed items between others."""
    short = [(i, [f"s{i}w{k}" for k in range(5 + i % 3)]) for i in range(20)]
    other, eight = [f"o{k}" for k in range(20)], [f"e{k}" for k in range(8)]
    docs = [(1, [w for _, t in short for w in t]), (2, ["one", *other[3:6], "two", *eight, "three"]), (3, other), (4, other[10:]), (5, other[10:])]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in [*short, (50, other), (51, eight)]], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in dc.contaminated(df, bench).collect()}
    assert got == {**{(1, i): 1.0 for i in range(20)}, (2, 51): 1.0, (3, 50): 1.0, (4, 50): 0.5, (5, 50): 0.5}


def edited(rng, item, rate):
    return [w if rng.random() >= rate else f"new{rng.randrange(10_000)}" for w in item]


def test_recall_of_edited_copies(spark, monkeypatch):
    """By the share of words replaced, each copy alone in its document; and with hot seeds dealt over salts."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(30)) for i in range(200)]
    rates = {0: 1.0, 1: 0.99, 2: 0.9}
    docs = [(1000 * k + i, " ".join(text(80) + edited(rng, t, k / 10) + text(80))) for k in rates for i, t in items]
    docs += [(9000 + i, " ".join(text(300))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench).collect()}
    for k, least in rates.items():
        assert sum((1000 * k + i, i) in got for i, _ in items) >= least * len(items), k
    assert all(d < 9000 and d % 1000 == i for d, i in got)
    monkeypatch.setattr(dc, "HOT_ROWS", 1)
    monkeypatch.setattr(dc, "HOT_PARTS", 1 << 30)
    assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench).collect()} == got


def test_items_of_one_and_two_words(spark):
    docs = [(1, "a lone word here"), (2, "two words"), (3, "words two"), (4, "Two, WORDS!"), (5, "lone"), (6, ""), (7, None), (8, "nothing"), (9, "one two three and lone")]
    items = [(1, "lone"), (2, "two words"), (3, "one two three"), (4, "..."), (5, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in dc.contaminated(df, bench).collect()}
    assert got == {(1, 1, 1.0), (5, 1, 1.0), (9, 1, 1.0), (2, 2, 1.0), (4, 2, 1.0), (9, 3, 1.0)}


def test_null_ids_go_by_their_text(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = [(None, f"before {item} after"), (None, "clean"), (1, item), (1, "clean too"), (2, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = dc.keep_clean(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(None, "clean"), (1, "clean too"), (2, None)]))


def test_op9_finds_every_verbatim_item(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r["item_id"], " ".join(words(r["text"]))) for r in stage.table(spark, sf, "benchmark").collect()]
    want = {(r["doc_id"], i) for r in stage.table(spark, sf, "documents").collect() for t in [" ".join(words(r["text"]))] for i, x in items if f" {x} " in f" {t} "}
    got = {(r["doc_id"], r["item_id"]) for r in registry.op9_decontamination(spark, sf).collect()}
    assert want and want == got
