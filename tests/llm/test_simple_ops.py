"""Brute-force twins of the chat, archive, line, shard and rule operators."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from emberline.llm import chat, lines, quality, registry, sharding, stage, warc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \t\n ", "one", "a b c", "\\", "<turn user>\n", "\n</turn>\n", "\\</turn> \\\\<next>", "héé ñ 漢字 \U0001f600 # $", "x " * 5000, "line a\nline b\nline a\n\nline a", "p q r s p q r s p q r"]


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def check_chats(spark, data, conv_rows):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, turns int")
    out = {r["conv_id"]: r for r in rows(chat.read_chats(chat.format_chats(df)))}
    assert set(out) == {d[0] for d in data}
    for conv, r in out.items():
        want = [(d[2] or "", d[3] or "") for d in sorted((d for d in data if d[0] == conv), key=lambda d: (d[1], d[2] or "", d[3] or ""))]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["loss_text"] == "".join(t for role, t in want if role == "assistant")


def test_chat_round_trip(spark):
    data = [(1, i, role, t, 0) for i, (role, t) in enumerate(zip(["user", "assistant", "assistant", "system", None, "user", "a>b\\<\n"] * 2, ODD))]
    data += [(2, 0, "assistant", t, 0) for t in ODD] + [(3, 5, "user", "hi", 0), (3, 5, "user", "hi", 0), (3, 4, "assistant", "\\", 0)]
    check_chats(spark, data, None)
    merged = rows(chat.format_chats(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")))[0]
    assert merged["n_blocks"] == 2 and merged["formatted"] == "<turn user>\na\n<next>\nb\n</turn>\n<turn assistant>\nc\n</turn>\n"
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_roles_and_conversations(spark):
    """A role of 3,000 characters overflowed the stack of the JVM's regular expressions."""
    odd = ["\\", "\\\\l", "\\l<g>\\", "<>", ">" * 5000, "x" * 20_000, "\\" * 4001, "a\n>\nb", "assistant", "assistant\\"]
    data = [(1, i, role, t, 0) for i, (role, t) in enumerate(zip(odd * 2, ODD * 2))]
    data += [(2, i, ("user", "assistant")[i // 3 % 2], f"text {i} \\ <next>", 0) for i in range(2000)] + [(2, 7, "user", "text 7 \\ <next>", 0), (None, 0, None, None, 0)]
    check_chats(spark, data, None)


def test_op1(spark):
    data = sorted(rows(stage.table(spark, SF, "conversations")), key=lambda r: (r["conv_id"], r["turn"]))
    want = {}
    for r in data:
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    want[-7] = [("user", registry.HARD_TEXT), ("assistant", registry.HARD_TEXT)]
    got = rows(registry.op1_chat_formatting(spark, SF))
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def pages_want(data):
    first = {}
    for r in data:
        body = (r["html"] or "").encode()
        if len(body) >= 100:
            first[body] = min(first.get(body, r["page_id"]), r["page_id"])
    out = []
    for r in data:
        body = (r["html"] or "").encode()
        f = first.get(body, r["page_id"])
        out.append((r["page_id"], len(body), sha(body), "response" if f == r["page_id"] else "revisit", None if f == r["page_id"] else f))
    return sorted(out)


def test_op3_and_hard_pages(spark, tmp_path):
    data = rows(stage.table(spark, SF, "pages"))
    got = registry.op3_warc(spark, SF)
    assert sorted(map(tuple, got.collect())) == pages_want(data)
    hard = [(i, None if i % 3 else f"http://h/{i}\r\n x", t) for i, t in enumerate([*ODD, "é漢" * 30000, "é漢" * 30000, "same " * 40, "same " * 40, "WARC/1.1\r\n\r\n" * 40, "x" * 99, "x" * 99])]
    df = spark.createDataFrame(hard, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    warc.write_archives(df, str(tmp_path / "w"))
    assert sorted(map(tuple, warc.resolved(spark, str(tmp_path / "w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == pages_want(rows(df))
    texts = {r["page_id"]: r["payload"] for r in rows(warc.read_archives(spark, str(tmp_path / "w"))) if r["record_type"] == "response"}
    assert all(bytes(b) == (hard[i][2] or "").encode() for i, b in texts.items())
    records = warc.read_records(spark, str(tmp_path / "w")).collect()
    assert sum(r["segment"] is not None for r in records) > 4
    assert len({r["record_id"] for r in records}) == len(records)


def test_repeated_and_null_pages(spark, tmp_path):
    """Two long pages of one id came back as one row, with a null payload where their texts differ."""
    long, other, again = "é漢" * 30_000, "x" * 50_000, "same " * 40
    data = [(1, "u", long), (1, "u", long), (1, "v", long), (2, "u", long), (3, None, other), (3, "u", long + "2"), (3, "u", long + "2"), (None, "u", long), (None, "u", other + "n"), (None, "u", other + "n"), (None, None, None), (4, "u", again), (4, "u", again), (5, "u", again), (6, "u", "short"), (6, "u", "short"), (7, "u", None), (7, "u", None)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "first", "again", "record")}).repartition(3)
    warc.write_archives(df, str(tmp_path / "w"))
    got = warc.resolved(spark, str(tmp_path / "w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    want = []
    for i, _, t in data:
        body = (t or "").encode()
        ids = [j for j, _, x in data if (x or "").encode() == body and j is not None]
        first = min(ids) if ids and len(body) >= 100 else i
        want.append((i, len(body), sha(body), "response" if first == i else "revisit", None if first == i else first))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    whole = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert all(r["complete"] for r in whole)
    assert Counter(bytes(r["payload"]) for r in whole if r["record_type"] == "response") == Counter((t or "").encode() for (i, _, t), w in zip(data, want) if w[3] == "response")
    records = warc.read_records(spark, str(tmp_path / "w")).collect()
    assert len({r["record_id"] for r in records}) == len(records)
    empty = str(tmp_path / "none")
    warc.write_archives(df.limit(0), empty)
    assert warc.resolved(spark, empty).count() == 0


def test_segments_that_do_not_fit(spark, tmp_path):
    spark.createDataFrame([(1, "u", "z" * 100_000)], "page_id long, url string, html string").transform(lambda d: warc.write_archives(d, str(tmp_path / "w")) or d)
    lines_ = spark.read.format("binaryFile").load(str(tmp_path / "w")).collect()
    import gzip

    raw = gzip.decompress(bytes(lines_[0]["content"]))
    (tmp_path / "cut").mkdir()
    at = raw.index(b"WARC/1.1", raw.index(b"WARC-Segment-Number: 2"))
    after = raw.index(b"WARC/1.1", at + 1)
    (tmp_path / "cut" / "a.warc").write_bytes(raw[:at] + raw[after:])
    (r,) = rows(warc.read_archives(spark, str(tmp_path / "cut")))
    assert r["payload"] is None and r["complete"] is False


def test_chunked_framing():
    for body in (b"", b"x", b"0\r\n\r\n" * 3000, bytes(range(256)) * 100):
        assert warc.unchunked(warc.chunked(body)) == body
    assert warc.unchunked(b"5\r\nab") is None and warc.unchunked(b"zz\r\n") is None


def brute_lines(data, min_sites):
    sites = {}
    for _, text, site in data:
        for x in (text or "").split("\n"):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).add(site)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for key, text, _ in data:
        if text is not None:
            text = "\n".join(x for x in text.split("\n") if x.strip(" ") not in bad)
        out.append((key, text))
    return out


def test_lines(spark):
    data = [(i, f"own text number {i} that is long enough to stay\nshared footer {i % 2}\nrare {i % 7}\n", f"s{i % 12}") for i in range(60)]
    data += [(100 + i, t, None) for i, t in enumerate(ODD)] + [(200, "shared footer 0", "s1"), (3, data[3][1], "s3")]
    data += [(None, "shared footer 1\nnull id", "s2"), (None, "shared footer 1\nnull id", "s2"), (3, "another text of 3\nshared footer 0", "s4")]
    clash = ["__hash", "hash", "check", "__bad", "__kept", "__row", "__cut", "__n_lines", "bad", "mark", "id", "doc", "kept", "place", "hit_id", "a.b"]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit("-"))) for c in clash})
    before = Counter(tuple(r[c] for c in clash if c != "__n_lines") for r in df.collect())
    for n in (3, 6, 7, 12):
        got = lines.drop_spread_lines(df, min_sites=n)
        assert Counter(tuple(r[c] for c in clash if c != "__n_lines") for r in got.collect()) == before
        assert sorted(map(str, [(r["doc_id"], r["text"]) for r in rows(got)])) == sorted(map(str, brute_lines(data, n)))
    assert lines.drop_spread_lines(df.limit(0)).count() == 0
    real = [(r["doc_id"], r["text"], r["source"]) for r in rows(stage.table(spark, SF, "documents"))]
    want = {k: sha(t) for k, t in brute_lines(real, 10)}
    assert {r["doc_id"]: r["kept_sha256"] for r in rows(registry.op5_line_dedup(spark, SF))} == want


def jump_hash(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    docs = rows(stage.table(spark, SF, "documents"))
    got = {r["doc_id"]: r for r in rows(registry.op6_sharding(spark, SF))}
    assert len(got) == len(docs)
    slots = Counter()
    for d in docs:
        r = got[d["doc_id"]]
        body = (d["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == (len(body) + 8, zlib.crc32(body), jump_hash(d["doc_id"], 24), jump_hash(d["doc_id"], 25))
    for s in range(24):
        mine = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert mine == list(range(len(mine)))
    keys = [0, -1, 1 << 62, -(1 << 63), (1 << 63) - 1, None, 5, 5, 5]
    df = spark.createDataFrame([(k, t) for k, t in zip(keys, ODD)], "k long, text string").withColumn("shard", F.lit(1))
    out = rows(sharding.assign(df, "k", "text", 7))
    assert len(out) == len(keys) and all(r["shard"] == jump_hash(r["key"] or 0, 7) for r in out)
    assert sharding.assign(df.limit(0), "k", "text", 7).count() == 0


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(hit)}


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_rule_counts(spark, monkeypatch, chunk):
    from emberline.llm import textbytes

    monkeypatch.setattr(textbytes, "CHUNK_BYTES", chunk)
    data = [(i, t) for i, t in enumerate([*ODD, *[r["text"] for r in rows(stage.table(spark, SF, "documents"))]])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in rows(quality.score(df, None))}
    for i, t in data:
        want = brute_counts(t)
        assert {k: got[i][k] for k in want} == want, (i, t)
        assert got[i]["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])


def test_quality_on_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = stage.table(spark, d, "documents"), stage.table(spark, d, "labels")
    held = labels.filter("pmod(doc_id, 5) = 0")
    model = quality.fit(docs, labels.filter("pmod(doc_id, 5) != 0"))
    got = rows(quality.score(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id"))
    right = sum((r["probability"] >= 0.5) == (r["quality"] == 1) for r in got)
    assert right / len(got) > 0.95
    assert quality.fit(docs, labels.filter("quality = 1")) is None
    assert quality.keep_good(docs.limit(0), model).count() == 0


def plain_texts(values, lower=True):
    import pyarrow as pa
    from emberline.llm.textbytes import Powers, Texts

    return Texts(pa.array(values, pa.string()), Powers(), lower)


def grams(text):
    """Word and character n-grams of a text, by group."""
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(t)
    return [w, [f"{a} {b}" for a, b in zip(w, w[1:])], [t[i : i + 3] for i in range(len(t) - 2)], [t[i : i + 5] for i in range(len(t) - 4)]]


def bucket(group, gram):
    """From a text that holds nothing but the n-gram."""
    found = quality.features(plain_texts([gram]))
    return int({0: found[0], 1: found[min(1, len(found) - 1)], 2: found[-1], 3: found[-1]}[group][0][0])


def test_classifier_against_dictionaries(spark):
    """Shares, weights and verdict by plain loops over n-grams of code points, and a dense fit."""
    import numpy as np

    good, bad = "the river runs by the old house é 漢字 in spring and".split(), "BUY now $$$ click here ñandú free 漢 offer win".split()
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randrange(3, 20))) for i in range(40)] + ["", "é", "a"]
    y = np.array([i % 2 for i in range(len(texts))], float)
    dense = np.zeros((len(texts), quality.BUCKETS))
    known = {}
    for i, t in enumerate(texts):
        for k, g in enumerate(grams(t)):
            for x in g:
                if (k, x) not in known:
                    known[k, x] = bucket(k, x)
                dense[i, known[k, x]] += 1 / len(g)
    import pyarrow as pa

    batch = quality._sparse_rows(pa.record_batch([pa.array(y.astype(np.int32))], ["y"]), plain_texts(texts))
    rows_ = quality.Rows(batch.column(1).offsets.to_numpy().astype(np.int64), batch.column(1).values.to_numpy(), batch.column(2).values.to_numpy())
    for i in range(len(texts)):
        lo, hi = rows_.off[i : i + 2]
        got = np.zeros(quality.BUCKETS)
        got[rows_.bucket[lo:hi]] = rows_.share[lo:hi]
        assert np.allclose(got, dense[i], atol=1e-6), texts[i]
    held = np.arange(len(texts)) // 2 % 4 == 0  # of both classes
    model = quality.fit_weights(y, rows_, held, np.ones(len(y)))
    w, g2, bias, train = np.zeros(quality.BUCKETS), np.full(quality.BUCKETS, 1e-8), 0.0, ~held
    balance = np.where(y == 1, 0.5 / (y[train] == 1).sum(), 0.5 / (y[train] == 0).sum()) * train
    for _ in range(quality.STEPS):
        err = (1 / (1 + np.exp(-(dense @ w + bias))) - y) * balance
        grad = dense.T @ err + quality.DECAY * w
        g2 += grad * grad
        w -= quality.RATE * grad / np.sqrt(g2)
        bias -= quality.RATE * err.sum()
    assert np.allclose(model.weights, w, atol=1e-3)
    p = 1 / (1 + np.exp(-(model.a * (dense @ model.weights) + model.b)))
    assert np.allclose(model.probability(plain_texts(texts)), p, atol=1e-5)
    assert ((p > 0.5) == (y == 1))[:40].mean() > 0.95


def test_labelled_rows_are_bounded(spark, monkeypatch):
    """A labelled id that stands in many rows, and very long labelled texts, do not swell the fit."""
    docs = [(i, f"text {i} " * 5) for i in range(30)] + [(0, "text 0 " * 5)] * 300 + [(1, f"other {k}") for k in range(50)] + [(2, "long " * 50_000)]
    labels = [(i, i % 2) for i in range(30)] + [(3, 0), (None, 1), (4, None), (5, 7), (99, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "y", "h", "size", "label")}).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("y", F.lit("x"))
    take = lambda n: Counter((r["y"], r["text"]) for r in quality.labelled_texts(df, lab, "doc_id", "text", "quality", n).collect())
    every = take(1000)
    assert every[0, "text 0 " * 5] == 1 and every[1, docs[3][1]] == 1 and every[0, docs[3][1]] == 1 and sum(every.values()) == 31 + 50 + 1
    monkeypatch.setattr(quality, "FIT_BYTES", 16 * 1000)
    assert max(len(t) for _, t in take(1000)) <= 1000
    small = take(10)
    assert Counter(y for y, _ in small.elements()).most_common(1)[0][1] <= 10
    monkeypatch.setattr(quality, "FIT_BYTES", 16 * 40)
    assert all(sum(len(t) * n for (y, t), n in take(1000).items() if y == k) <= 640 for k in (0, 1))
