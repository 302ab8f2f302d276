"""All models against plain dictionaries, with each document's own counts left out."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from emberline.llm import lm_scoring as lm
from emberline.llm import registry, stage
from pyspark.sql import functions as F


def brute(texts, model, models):
    """texts: lists of words; model: of each. Per text: words, target, background, score, corpus loss."""
    def counts(some):
        pairs, words = Counter(), Counter()
        for t in some:
            pairs.update(zip([None, *t], t))
            words.update(t)
            if t:
                words[None] += 1  # the start
        return pairs, words, sum(map(len, some))

    v = len({w for t in texts for w in t})
    all_ = [counts([t for t, k in zip(texts, model) if k == m]) for m in range(models)] + [counts(texts)]
    least = min([n for *_, n in all_[:-1] if n] or [1])
    out = []
    for t, k in zip(texts, model):
        own, loss = counts([t]), []
        for m, (pairs, words, n) in enumerate(all_):
            scale, mine = least / n if n and m < models else 1.0, m in (k, models)
            total = 0.0
            for a, b in zip([None, *t], t):
                p = (scale * (words[b] - mine * own[1][b]) + 1) / (scale * (n - mine * len(t)) + v + 1)
                total -= math.log((scale * (pairs[a, b] - mine * own[0][a, b]) + lm.PRIOR * p) / (scale * (words[a] - mine * own[1][a]) + lm.PRIOR))
            loss.append(total / len(t) if t else None)
        back = sum(loss[1:-1]) / (models - 1) if t else None
        out.append((len(t), loss[0], back, loss[0] - back if t else None, loss[-1]))
    return out


def scored(spark, data, target, **kw):
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"id": F.lit("x"), "seq": F.lit(1), "model": F.lit(2), "target": F.lit("y")}).repartition(3)
    return lm.score_documents(df, spark.createDataFrame([(i,) for i in target], "k long"), **kw)


def expected(spark, data, target):
    size = [sum(len((t or "").encode()) for i, t in data if (i in target) == k) for k in (True, False)]
    models = 1 + lm.background_models(*size)
    dealt = spark.createDataFrame(data, "id long, text string").withColumn("m", F.pmod(F.xxhash64("id", "text"), F.lit(models - 1))).collect()
    want = brute([(t or "").lower().split() for _, t in data], [0 if r["id"] in target else 1 + r["m"] for r in dealt], models)
    return models, sorted(((d[0], *w) for d, w in zip(data, want)), key=repr)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[4] or 0)), sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[4] or 0))):
        assert a[:2] == b[:2] and all(x == y if y is None else x == pytest.approx(y, rel=1e-9, abs=1e-9) for x, y in zip(a[2:], b[2:])), (a, b)


@pytest.mark.parametrize("words, entries, every", [(20, 50, 3), (1 << 20, 1 << 20, 3), (100, 700, 9)])
def test_against_dictionaries(spark, monkeypatch, words, entries, every):
    monkeypatch.setattr(lm, "CHUNK_WORDS", words)
    monkeypatch.setattr(lm, "RANGE_ENTRIES", entries)
    rng = random.Random(2)
    data = [(i, " ".join(f"W{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    data += [(100, None), (101, ""), (102, "alone"), (103, " \n alone"), (5, data[5][1]), (5, "another text of five"), (None, "a null id"), (None, "a null id"), (104, "long " * 3000)]
    target = {i for i in range(0, 80, every)} | {102}
    models, want = expected(spark, data, target)
    assert models > 2
    same([tuple(r) for r in scored(spark, data, [*target, 5000, 0]).collect()], want)


def test_empty_tables_and_targets(spark):
    data = [(1, "a b c"), (2, None), (3, "a b")]
    assert scored(spark, [], [1]).count() == 0
    for target in ([], [1, 2, 3]):
        models, want = expected(spark, data, set(target))
        assert models == 2
        same([tuple(r) for r in scored(spark, data, target).collect()], want)


def test_one_distribution_scores_alike(spark):
    """The score told whether a document was among those that the model was made from."""
    rng = np.random.default_rng(5)
    p = 1 / np.arange(1, 2001)
    data = [(i, " ".join(f"w{k}" for k in rng.choice(2000, 80, p=p / p.sum()))) for i in range(400)]
    got = scored(spark, data, range(0, 400, 2)).collect()
    named, others = (np.array([r["score"] for r in got if r["id"] % 2 == k]) for k in (0, 1))
    assert abs(named.mean() - others.mean()) < 0.1 and abs(np.concatenate([named, others]).mean()) < 0.1


def test_repeated_texts_stand_apart(spark):
    rng = np.random.default_rng(6)
    p = 1 / np.arange(1, 3001)
    text = lambda: " ".join(f"w{k}" for k in rng.choice(3000, 120, p=p / p.sum()))
    data = [(i, text()) for i in range(300)]
    data += [(1000 + i, data[i][1]) for i in range(30)]
    got = {r["id"]: r["corpus_loss"] for r in scored(spark, data, range(0, 300, 3)).collect()}
    least = np.quantile([got[i] for i in range(30, 300)], 0.05)
    assert sum(got[k] < least for i in range(30) for k in (i, 1000 + i)) >= 0.9 * 60


def test_op2_separates_good_from_bad(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op2_lm_scoring(spark, sf).join(stage.table(spark, sf, "labels"), "doc_id").filter("score is not null").select("score", "quality").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) < sum(bad) / len(bad)
    cut = sorted(good)[int(0.9 * len(good))]
    assert sum(s > cut for s in bad) > 0.65 * len(bad)  # 0.73 as measured, held out


def test_rare_words_are_told_apart(spark):
    """20,200 words, most of them once: a vocabulary of fixed size gave documents 0 and 1 the same losses."""
    data = [(i, " ".join(f"w{100 * i + k}" for k in range(100))) for i in range(200)] + [(200 + i, " ".join(f"w{k}" for k in range(50))) for i in range(5)]
    data += [(300, " ".join(f"w{20_000 + k}" for k in range(200))), (301, " ".join(f"w{100 + k}" for k in range(50)))]
    target = {0, 2, 200, 201}
    got = sorted((tuple(r) for r in scored(spark, data, target).collect()), key=repr)
    same(got, expected(spark, data, target)[1])
    by_id = {r[0]: r for r in got}
    assert by_id[0][4] < by_id[1][4]
