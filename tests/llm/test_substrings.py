"""Repeated strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import pytest
from emberline.llm import registry, stage, substrings
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def brute(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def answer(df, width):
    got = substrings.drop_repeats(df, width=width)
    return sorted((r["id"], r["n_bytes"], r["n_removed"], r["n"], r["s"]) for r in got.select("id", "n_bytes", "n_removed", F.size("span_start").alias("n"), F.sha2("kept", 256).alias("s")).collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(30), text(120)
    docs = [text(rng.randrange(0, 120)) for _ in range(40)]
    docs += [text(20) + " " + passage + " " + text(30) for _ in range(25)] + [base] * 4
    docs += [" ".join(w if rng.random() > 0.02 else word() for w in base.split()) for _ in range(15)]
    docs += [None, "", "x", "a" * 1500, "ab" * 600, passage + " " + text(3) + " " + passage, text(400)]
    return docs


@pytest.mark.parametrize("width,group", [(40, 8 << 20), (40, 700), (100, 0), (7, 8 << 20), (7, 0)])
def test_against_all_windows(spark, monkeypatch, width, group):
    """group: bytes from which a group is refined as a table."""
    monkeypatch.setattr(substrings, "GROUP_BYTES", group)
    monkeypatch.setattr(substrings, "SORT_BYTES", 3000)
    docs = corpus(width)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({"h": F.lit("x"), "digest": F.lit(1)}).repartition(3)
    assert answer(df, width) == [(i, *w) for i, w in enumerate(brute(docs, width))]


def test_repeated_rows(spark):
    docs = ["some text of its own " * 3, "q" * 10, None]
    df = spark.createDataFrame([(1, docs[0]), (1, docs[0]), (1, docs[1]), (None, docs[2])], "doc_id long, text string")
    got = answer(df.filter("doc_id is not null"), 30)
    assert got == sorted((1, *w) for w in brute([docs[0], docs[0], docs[1]], 30))
    assert answer(df.limit(0), 30) == [] and substrings.drop_repeats(df, width=30).count() == 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.integers(1, 40))
def test_refinement(texts, width):
    pieces = [t.encode() for t in texts]
    seen = Counter(p[i : i + width] for p in pieces for i in range(len(p) - width + 1))
    want = [i + width <= len(p) and seen[p[i : i + width]] > 1 for p in pieces for i in range(len(p))]
    assert substrings.repeated_windows(pieces, width).tolist() == want


@pytest.mark.parametrize("width", [5, 8, 11, 20, 70])
def test_refinement_as_tables(spark, width):
    rng = random.Random(width)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    pieces = [b"", b"x", base, base[100:220] + b"cc" + base[:90], b"a" * 200, b"a" * 60, bytes(rng.choice(b"ab") for _ in range(120)), base[5:80], base[250:] + base[:40]]
    df = spark.createDataFrame([(10 * k, bytearray(p)) for k, p in enumerate(pieces)], "piece long, bytes binary").repartition(3)
    seen = Counter(p[i : i + width] for p in pieces for i in range(len(p) - width + 1))
    want = {(10 * k, i) for k, p in enumerate(pieces) for i in range(len(p) - width + 1) if seen[p[i : i + width]] > 1}
    got = [tuple(r) for r in substrings.refined(df, width).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_op8_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in stage.table(spark, sf, "documents").collect())
    got = sorted(map(tuple, registry.op8_suffix_array_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == [(i, *w) for (i, _), w in zip(docs, brute([t for _, t in docs], 200))]
