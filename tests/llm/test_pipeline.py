"""Each stage against a brute-force version on its own input."""

import public_tokenizers as P
import sentencepiece

import corpus_pipeline
from test_decontamination import words
from test_minhash import brute as near_brute
from test_simple_ops import brute_counts, brute_lines
from emberline.llm import stage
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = stage.table(spark, SF, "documents")
    columns = docs.columns
    items = [" ".join(words(r["text"])) for r in stage.table(spark, SF, "benchmark").collect()]
    quality = {r["doc_id"]: r["quality"] for r in stage.table(spark, SF, "labels").collect()}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage.persisted(step(spark, docs, SF), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            for i, r in before.items():
                c = brute_counts(r["text"])
                if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]:
                    assert i not in after
            assert all(after[i] == before[i] for i in after)
            judged = [(i in after, quality[i]) for i in before if i in quality and brute_counts(before[i]["text"])["n_words"] >= 50]
            assert sum(a == bool(b) for a, b in judged) / len(judged) > 0.97
        elif k == 1:
            want = dict(brute_lines([(i, r["text"], r["source"]) for i, r in before.items()], 10))
            assert {i: r["text"] for i, r in after.items()} == want and all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif k == 2:
            want = near_brute([(i, r["text"]) for i, r in before.items()], 5)
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
        elif k == 3:
            gone = {i for i, r in before.items() if any(f" {x} " in f" {' '.join(words(r['text']))} " for x in items)}
            assert gone and set(after) == set(before) - gone
        else:
            own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
            assert {i: r["token_ids"] for i, r in after.items()} == {i: own.encode(r["text"]) for i, r in before.items()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(after)


def small_tables(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_hard_and_empty_tables(spark, tmp_path):
    body = " ".join(f"word{i % 997} and{i % 13}" for i in range(60))
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(90_000))
    docs = [(1, None, None, None, None), (None, body, "en", "s", 1), (2, "", "en", "s", 0), (3, body, "en", None, 5), (3, body, "en", None, 5), (4, long, None, "s", 9), (5, "a" * 400_000, "en", "s", 1), (6, body + " other", "en", "t", 2), (7, "\n\n \t\n", "en", "s", 1)]
    hard = small_tables(spark, tmp_path / "hard", docs, [(1, 1, 0), (None, 0, None), (4, None, 1), (3, 1, 0)], [(1, None), (None, "one two three four"), (2, "")])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.run(spark, hard).collect())
    assert got == [(False, 3), (False, 3), (False, 4), (True, 0)]
    from emberline.llm import registry

    for name in ("op2_lm_scoring", "op4_minhash_near_dedup", "op5_line_dedup", "op6_sharding", "op7_quality_rules", "op8_suffix_array_dedup", "op10_sentencepiece"):
        assert registry.QUERIES[name](spark, hard).count() == len(docs), name
    assert registry.QUERIES["op9_decontamination"](spark, hard).count() == 0
    empty = small_tables(spark, tmp_path / "empty", [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
    for name in ("op2_lm_scoring", "op4_minhash_near_dedup", "op5_line_dedup", "op6_sharding", "op7_quality_rules", "op8_suffix_array_dedup", "op9_decontamination", "op10_sentencepiece"):
        assert registry.QUERIES[name](spark, empty).count() == 0, name


def test_columns_of_any_name(spark, tmp_path):
    """Names that the stages use themselves pass through, and do not change what stays."""
    rng = __import__("random").Random(3)
    body = lambda: " ".join(f"word{rng.randrange(900)}" for _ in range(70))
    item = " ".join(f"item{k}" for k in range(20))
    texts = [body() for _ in range(12)]
    docs = [(i, f"{t}\nfooter of all sites", "en", f"s{i}", 0) for i, t in enumerate(texts)] + [(20, texts[3], "en", "s1", 0), (21, f"{body()} {item}", "en", "s2", 0), (22, "short", "en", "s3", 0)]
    sf = small_tables(spark, tmp_path / "t", docs, [(1, 1, 0)], [(1, item)])
    clash = ["id", "h", "y", "size", "label", "mark", "rep", "first", "component_id", "__gone", "__gone_row", "row", "run", "doc", "kept", "n_shingles", "hash", "digest", "v", "probability", "n_tokens", "__n_lines"]
    plain = stage.table(spark, sf, "documents")
    wide = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in clash if c != "__n_lines"})
    for _, step in corpus_pipeline.STAGES[:4]:
        plain, wide = step(spark, plain, sf), step(spark, wide, sf)
        assert wide.columns == [*plain.columns, *[c for c in clash if c != "__n_lines"]]
        got = wide.collect()
        assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got) == sorted((r["doc_id"], r["text"], r["n_chars"]) for r in plain.collect())
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in clash if c != "__n_lines")
    assert sorted(r["doc_id"] for r in got) == list(range(12)) and all("footer" not in r["text"] for r in got)
    last = corpus_pipeline.STAGES[4][1]
    assert sorted(map(tuple, last(spark, wide, sf).collect())) == sorted(map(tuple, last(spark, plain, sf).collect()))


def test_spread_lines_leave_texts_of_any_share(spark):
    """A page whose spread line is longer than its own text stayed whole, though no other page is like it."""
    footer = " ".join(f"footer{i}" for i in range(100))
    docs = [(i, f"{' '.join(f'own{i}word{k}' for k in range(60 if i else 10))}\n {footer}", f"s{i}") for i in range(12)] + [(20, footer, "s1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    want = {i: "\n".join(x for x in t.split("\n") if x.strip(" ") != footer) for i, t, _ in docs}
    assert got == {i: (t, len(t)) for i, t in want.items()}
