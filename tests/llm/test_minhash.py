"""Near duplicates against all pairs, and components against a union-find."""

import random
import re

import pytest
from emberline.llm import minhash, registry, stage
from emberline.operators.graph import components
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(data, n, num=4, den=5):
    s = {i: sets(t, n) for i, t in data}
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, x in s.items():
        for g in x:
            where.setdefault(g, []).append(i)
    for i, x in s.items():
        for j in {j for g in x for j in where[g] if j > i}:
            both = len(x & s[j])
            if both * den >= num * (len(x) + len(s[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s[i]), top(i)) for i in s}


def edited(rng, words, rate):
    return [rng.choice("abcdefgh") * 3 + str(rng.randrange(999)) if rng.random() < rate else w for w in words]


def group(seed, base_len, copies, rates, start):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(base_len)]
    return [(start + i, " ".join(edited(rng, base, rng.choice(rates)))) for i in range(copies)]


@pytest.mark.parametrize("n,block", [(4, 1024), (5, 16)])
def test_against_all_pairs(spark, monkeypatch, n, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    data = group(1, 150, 120, [0.01, 0.03, 0.05, 0.06], 0) + group(2, 600, 60, [0.005, 0.02, 0.03, 0.04], 1000) + group(3, 18, 60, [0, 0.03], 2000) + group(4, 2500, 12, [0.01, 0.02, 0.04], 3000)
    line = "this very common line stands in a great many of the texts here "
    rng = random.Random(9)
    data += [(4000 + i, line + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 6, 40])))) for i in range(200)]
    data += [(5000, None), (5001, ""), (5002, " \n"), (5003, "One"), (5004, "one"), (5005, "one two three"), (5006, "one  TWO three"), (5007, "é è à ç"), (5008, "É è à ç"), (5009, data[0][1].upper())]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"rep": F.lit("x"), "v": F.lit(1)}).repartition(3)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, n=n).collect()}
    want = brute(data, n)
    assert {k: v for k, v in got.items() if want[k] != v} == {}
    kept = {r["doc_id"] for r in minhash.keep_one(df, n=n).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def brute_rows(rows, n):
    """Components of ids that may stand in several rows; a row each."""
    numbered = [((i, k), t) for k, (i, t) in enumerate(rows) if i is not None]
    found = brute(numbered, n)
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, _), (_, (j, _)) in found.items():
        a, b = sorted((top(i), top(j)))
        up[b] = a
    return [(i, len(sets(t, n)), None if i is None else top(i)) for i, t in rows]


def check_rows(spark, rows, n=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "mark", "first", "rep", "component_id")}).repartition(3)
    want = brute_rows(rows, n)
    got = [(r["id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, n=n).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [(r["doc_id"], r["text"]) for r in minhash.keep_one(df, n=n).collect()]
    assert sorted(kept, key=str) == sorted(((i, t) for (i, t), (_, _, c) in zip(rows, want) if i == c), key=str)


def test_repeated_rows_and_null_ids(spark):
    """Of an id with two texts only one kept its links, and which one depended on the order of rows."""
    near = lambda words, k: " ".join([*words[:k], "changed", *words[k + 1 :]])
    x, y, z = ([f"{c}{i}" for i in range(80)] for c in "xyz")
    rows = [(5, " ".join(x)), (5, " ".join(y)), (7, near(x, 3)), (8, near(y, 4)), (9, " ".join(z)), (9, " ".join(z)), (10, near(z, 5)), (2, near(z, 5))]
    check_rows(spark, rows)
    check_rows(spark, [*rows, (5, None), (9, ""), (11, None), (11, None), (None, " ".join(x)), (None, " ".join(x)), (None, None), (12, near(x, 3).upper()), (7, near(x, 3))])
    check_rows(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0 and minhash.keep_one(df).count() == 0


def test_op4_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    data = [(r["doc_id"], r["text"]) for r in stage.table(spark, sf, "documents").collect()]
    want = brute(data, 4)
    got = registry.op4_minhash_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 500 + i) for i in range(200)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)] + [(3, 3)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}
