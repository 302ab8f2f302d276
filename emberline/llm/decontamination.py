"""Contamination of documents with test items: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters and digits and of bytes above 127, lower-cased for A-Z. Items longer than SEGMENT words
are aligned in segments that overlap by half. The seeds of a segment are the rarest SEED_SHARE of its distinct SEED
word n-grams, by their count over all documents: a rank inside the segment, so a passage that leaked into a third of
all documents keeps its seeds. Documents are read once: runs of n-grams that are in the benchmark are kept with the
words around them. All distinct seeds of a run join the seed table; the words are attached to the distinct pairs of run
and segment, so a pair is aligned once, however many seeds it shares.

Alignment: match +1, mismatch and gap -1. A segment is found where its best local alignment scores at least MIN_SCORE of
its length, and MIN_MATCH (all of a shorter one). Copies of 30 words with one word in five replaced reach that nine
times in ten; the tests measure it. An item with fewer than SEED words is its own seed and is found as it stands.

What is broadcast: a bit set of fixed size, which only spares work, as the join decides, and the seeds that make up
1 / HOT_PARTS of all n-grams found or more, so HOT_PARTS of them at most. Those are dealt over SALTS keys in the join. A
run longer than RUN_WORDS is cut with overlap, so very long texts give bounded rows. Null and empty texts and items
match nothing; a repeated document or item gives its pair once. A null id is kept as null, and texts that share an id
are told apart by a hash of the text. Empty tables give no rows. Other columns are not read, whatever their names;
keep_clean passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stage
from .textbytes import distinct_by_doc, map_text, shingles, Texts, trimmed

SEED = 3
SEED_SHARE = 0.75
SEGMENT = 128
RUN_WORDS = 1024
GAP_WORDS = 8
MIN_SCORE = 0.4
#: Least score, where the segment has so many words.
MIN_MATCH = 6
HOT_PARTS = 1024
#: Rows of a seed that stay together in any case.
HOT_ROWS = 1 << 16
SALTS = 64
#: Bits of the broadcast set, 4 MB.
FILTER_BITS = 1 << 25
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    start, end, doc = t.word_bounds(_BETWEEN)
    return t.span(t.prefix_hash(), start, end), doc


def _grams(word: np.ndarray, doc: np.ndarray, n_docs: int, n: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each whole n-gram, and the word it begins at."""
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(word) >= n else np.zeros(0, np.int64)
    return shingles(word, doc, n, n_docs)[0][: len(at)], at


def _code(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(32)).astype(np.uint32).view(np.int32)


def segments(items: DataFrame, key: str, text: str) -> DataFrame:
    """item_id, part, words (32-bit codes) and grams of each segment of an item."""

    def rows(part: pa.RecordBatch, t: Texts) -> pa.RecordBatch:
        word, doc = _words(t)
        off = np.searchsorted(doc, np.arange(t.n + 1))
        out: list[tuple] = []
        for i in range(t.n):
            own = word[off[i] : off[i + 1]]
            for k, a in enumerate(range(0, max(len(own) - SEGMENT // 2, 1), SEGMENT // 2)):
                w = own[a : a + SEGMENT]
                if len(w):
                    grams, _ = _grams(w, np.zeros(len(w), np.int64), 1, min(len(w), SEED))
                    out.append((part.column("item_id")[i].as_py(), k, _code(w).tolist(), np.unique(grams).view(np.int64).tolist()))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], ["item_id", "part", "words", "grams"])

    return map_text(items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")), "text", rows, "item_id long, part int, words array<int>, grams array<long>", lower=True)


def bit_set(hashes: DataFrame) -> np.ndarray:
    """FILTER_BITS bits with those of the column h set, as bytes."""
    cells = hashes.groupBy(F.shiftrightunsigned("h", 64 - (FILTER_BITS // 64).bit_length() + 1).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    got = cells.toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    cell = (h >> np.uint64(64 - (FILTER_BITS // 64).bit_length() + 1)).astype(np.int64)
    return (bits[cell] >> (h & np.uint64(63))) & np.uint64(1) != 0


def passages(docs: DataFrame, key: str, text: str, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """doc_id, row (hash of the text), grams found (at, h) and the words around them, a row for each run. sizes: of the
    n-grams, SEED and those of shorter items."""

    def rows(part: pa.RecordBatch, t: Texts) -> pa.RecordBatch | None:
        word, doc = _words(t)
        h, at = (np.concatenate(x) for x in zip(*(_grams(word, doc, t.n, n) for n in sizes), strict=True))
        hit = _in(bits, h)
        h, at = h[hit], at[hit]
        if not len(h):
            return None
        if len(sizes) > 1:
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
        d = doc[at]
        new = np.ones(len(at), bool)
        new[1:] = (d[1:] != d[:-1]) | (np.diff(at) > GAP_WORDS)
        run_start = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        piece = (at - run_start) // RUN_WORDS  # long runs are cut; the words around a cut stand on both sides of it
        new[1:] |= piece[1:] != piece[:-1]
        first = np.flatnonzero(new)
        stop = np.append(first[1:], len(at))
        off = np.searchsorted(doc, np.arange(t.n + 1))
        own = d[first]
        a = np.maximum(at[first] - SEGMENT - SEGMENT // 2, off[own])
        b = np.minimum(at[stop - 1] + SEED + SEGMENT + SEGMENT // 2, off[own + 1])
        size = b - a
        total = np.cumsum(size)
        words = _code(word)[np.arange(total[-1]) - np.repeat(total - size, size) + np.repeat(a, size)]
        return pa.record_batch([
            part.column("doc_id").take(pa.array(own)),
            part.column("row").take(pa.array(own)),
            pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(h.view(np.int64))),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], total]), pa.int32()), pa.array(words)),
        ], ["doc_id", "row", "grams", "words"])

    return map_text(docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text")), "text", rows, "doc_id long, row long, grams array<long>, words array<int>", lower=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, n = np.unique(batch.column("grams").flatten().to_numpy(), return_counts=True)
        yield pa.record_batch([pa.array(h), pa.array(n)], ["h", "n"])


def _seeds(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("grams")
            h = col.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), col.value_lengths().to_numpy())
            seed = _in(bits, h.view(np.uint64))
            h, row = h[seed], row[seed]
            h, row = distinct_by_doc(h, row)
            yield pa.record_batch([batch.column("run").take(pa.array(row)), pa.array(h)], ["run", "h"])

    return run


def best_scores(words: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment of words[i] and items[i]: match +1, mismatch and gap -1."""
    out = np.zeros(len(words), np.int32)
    order = np.argsort([len(w) * 4096 + len(x) for w, x in zip(words, items, strict=True)], kind="stable")
    for lo in range(0, len(order), 256):
        some = order[lo : lo + 256]
        n, m = max(len(words[i]) for i in some), max(len(items[i]) for i in some)
        text, item = np.full((len(some), n), -1, np.int64), np.full((len(some), m), -2, np.int64)
        for k, i in enumerate(some):
            text[k, : len(words[i])], item[k, : len(items[i])] = words[i].view(np.uint32), items[i].view(np.uint32)
        above, best, at = np.zeros((len(some), n + 1), np.int32), np.zeros(len(some), np.int32), np.arange(n + 1, dtype=np.int32)
        for j in range(m):
            here = np.zeros_like(above)
            here[:, 1:] = np.maximum(above[:, :-1] + np.where(text == item[:, j : j + 1], 1, -1), above[:, 1:] - 1)
            np.maximum(here, 0, out=here)
            above = np.maximum.accumulate(here + at, axis=1) - at  # gaps along the text
            np.maximum(best, above.max(axis=1), out=best)
        out[some] = best
    return out


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.asarray(x.values) for x in batch.column(c)] for c in ("words", "item_words"))
        best = best_scores(a, b)
        size = np.array([len(x) for x in b], np.int32)
        part = pa.record_batch([batch.column("doc_id"), batch.column("row"), batch.column("item_id"), pa.array(best), pa.array(size)], ["doc_id", "row", "item_id", "best", "size"])
        yield part.filter(pa.array((best >= MIN_SCORE * size) & (best >= np.minimum(size, MIN_MATCH))))


def _matches(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """doc_id, row, item_id, best and size of each passage that holds an item."""
    parts = stage.persisted(segments(items, item_key, item_text), "segments")
    sizes = sorted({SEED, *(r[0] for r in parts.select(F.least(F.size("words"), F.lit(SEED))).distinct().collect())})
    grams = parts.select("item_id", "part", F.size("grams").alias("n"), F.explode("grams").alias("h"))
    found = stage.persisted(passages(docs, key, text, bit_set(grams), sizes).withColumn("run", F.monotonically_increasing_id()), "passages")
    counts = stage.persisted(found.select("grams").mapInArrow(trimmed(_counted), "h long, n long").groupBy("h").agg(F.sum("n").alias("count")), "gram-counts")
    hot_at = max(HOT_ROWS, (counts.agg(F.sum("count")).first()[0] or 0) // HOT_PARTS)
    by_count = W.partitionBy("item_id", "part").orderBy("count", "h")
    seeds = grams.join(counts, "h").withColumn("rank", F.row_number().over(by_count) + F.col("n") - F.count("*").over(W.partitionBy("item_id", "part")))
    seeds = stage.persisted(seeds.filter(F.col("rank") <= F.ceil(F.col("n") * SEED_SHARE)).select("item_id", "part", "h", (F.col("count") >= hot_at).alias("hot")), "seeds")
    hot = seeds.filter("hot").select("h", "hot").distinct()  # HOT_PARTS at most, as each has that share of all
    picked = found.select("run", "grams").mapInArrow(trimmed(_seeds(bit_set(seeds))), "run long, h long").join(F.broadcast(hot), "h", "left")
    picked = picked.select("run", "h", F.when(F.col("hot"), F.pmod("run", F.lit(SALTS))).otherwise(0).alias("salt"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    pairs = picked.join(seeds.select("item_id", "part", "h", F.explode(salts).alias("salt")), ["h", "salt"]).select("run", "item_id", "part").distinct()
    named = pairs.join(found.select("run", "doc_id", "row", "words"), "run").join(parts.select("item_id", "part", F.col("words").alias("item_words")), ["item_id", "part"])
    return named.select("doc_id", "row", "item_id", "words", "item_words").mapInArrow(trimmed(_scored), "doc_id long, row long, item_id long, best int, size int")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id and score of each document that holds an item."""
    scored = _matches(docs, items, key, text, item_key, item_text)
    return scored.groupBy("doc_id", "item_id").agg(F.max(F.col("best") / F.col("size")).alias("score"))


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that hold an item; the columns stay as they are."""
    found = _matches(docs, items, key, text, "item_id", "text")
    gone = stage.persisted(found.select(F.col("doc_id").alias("__gone"), F.col("row").alias("__gone_row")).distinct(), "contaminated")
    return docs.join(gone, docs[key].cast("long").eqNullSafe(gone["__gone"]) & (F.xxhash64(docs[text]) == gone["__gone_row"]), "left_anti")
