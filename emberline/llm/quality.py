"""Quality rules: exact counts per text, and a calibrated logistic regression on hashed n-grams.

Words are runs of bytes other than ASCII white space. Counts are taken over whole texts; a null or empty text has
zeros everywhere and fails the base rules. The classifier reads lower-cased (A-Z) words: hashed word 1- and 2-grams
and character 3- and 5-grams (of code points), each group as shares that sum to 1, in BUCKETS weights. It is fitted on
the driver to at most FIT_ROWS labelled texts of each class, those of the smallest hashes, FIT_BYTES of them at most and
none longer than a sixteenth of that; calibrated by Platt scaling on the held-out quarter with the classes weighted as
in all labels; and applied in Arrow batches. Without labels of both classes there is no verdict against a text.

Repeated and conflicting labels count as rows of their own; rows of documents that repeat a labelled id and text count
once. Labels with a null id or another value are left out. An empty table gives no rows. Very long texts are judged
whole, one at a time. score reads only the key and the text; keep_good passes all columns through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stage
from .textbytes import _SPACE, Texts, map_text, mix

BUCKETS = 1 << 18
FIT_ROWS = 1000
#: Bytes of text of each class that the fit reads at most.
FIT_BYTES = 8 << 20
#: Features that the fit takes at a time.
BLOCK = 1 << 20
THRESHOLD = 0.5
MIN_WORDS = 50
STEPS, RATE, DECAY = 200, 0.5, 1e-5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Odd factors of a character by its place in an n-gram.
_PLACE = np.random.default_rng(4242).integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    solid = ~_SPACE[t.raw]
    start, end, doc = t.word_bounds()
    prefix = t.prefix_hash()
    word = t.span(prefix, start, end)
    out = {"n_words": np.bincount(doc, minlength=t.n), "word_chars": _per_text(solid & ((t.raw & 0xC0) != 0x80), t.off), "n_symbols": _per_text(_SYMBOL[t.raw], t.off)}

    cut = np.unique(np.concatenate([t.off, np.flatnonzero(t.raw == 10) + 1]))
    first, last = cut[:-1], cut[1:]
    if len(first):
        last = np.where(t.raw[last - 1] == 10, last - 1, last)  # the line feed itself is no part of the line
    c = np.concatenate([[0], np.cumsum(solid)])
    real = c[last] > c[first]
    first, last = first[real], last[real]
    line_doc = np.searchsorted(t.off, first, "right") - 1
    key = t.span(prefix, first, last)
    order = np.lexsort((key, line_doc))
    k, d = key[order], line_doc[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    out["n_dup_lines"] = np.bincount(d[again], minlength=t.n)

    covered = np.zeros(len(word), bool)
    if len(word) >= 3:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        h = mix(word[at] * np.uint64(0x9E3779B97F4A7C15) + mix(word[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(word[at + 2] + doc[at].astype(np.uint64))))
        order = np.argsort(h)
        s = h[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        twice = at[order[same[:-1] | same[1:]]]
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=t.n)
    return out


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def characters(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each character as one number, and its text."""
    lead = (t.raw & 0xC0) != 0x80
    if lead.all():
        return t.raw.astype(np.uint64), np.repeat(np.arange(t.n), np.diff(t.off))
    start = np.flatnonzero(lead)
    size = np.diff(start, append=len(t.raw))
    code = t.raw[start].astype(np.uint64)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << np.uint64(8) | t.raw[start[more] + k]
    return code, np.searchsorted(t.off, start, "right") - 1


def features(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of (bucket, text), sorted by text. t must be lower-cased."""
    word, doc = t.word_hashes()
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    groups = [(mix(word + np.uint64(1)) >> shift, doc)]
    if len(word) > 1:
        two = np.flatnonzero(doc[:-1] == doc[1:])
        groups.append((mix(word[two] * np.uint64(0xC2B2AE3D27D4EB4F) + word[two + 1]) >> shift, doc[two]))
    code, owner = characters(t)
    for n in (3, 5):
        if len(code) >= n:
            h = np.full(len(code) - n + 1, n, np.uint64)
            for k in range(n):
                h += code[k : k + len(h)] * _PLACE[k]
            inside = owner[: len(h)] == owner[n - 1 :]
            h = h[inside]
            groups.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift, owner[: len(inside)][inside]))
    return [(b.astype(np.int64), d) for b, d in groups]


@dataclass
class Model:
    """p(good) = 1 / (1 + exp(-(a * z + b))), z the weighted shares of a text."""

    weights: np.ndarray
    a: float
    b: float

    def probability(self, t: Texts) -> np.ndarray:
        z = np.zeros(t.n)
        for bucket, doc in features(t):
            c = np.zeros(len(bucket) + 1)
            np.cumsum(self.weights[bucket], out=c[1:])
            off = np.searchsorted(doc, np.arange(t.n + 1))
            z += (c[off[1:]] - c[off[:-1]]) / np.maximum(np.diff(off), 1)
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -50, 50)))


def _sparse_rows(part: pa.RecordBatch, t: Texts) -> pa.RecordBatch:
    keys, shares = [], []
    for bucket, doc in features(t):
        key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
        keys.append(key)
        shares.append(n / np.bincount(doc, minlength=t.n)[key // BUCKETS])
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(at, np.concatenate(shares), len(key)).astype(np.float32)
    off = pa.array(np.searchsorted(key, np.arange(t.n + 1) * BUCKETS), pa.int32())
    rest = [c for c in part.schema.names if c not in ("y", "text")]
    return pa.record_batch([part.column("y"), pa.ListArray.from_arrays(off, pa.array((key % BUCKETS).astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(value)), *map(part.column, rest)], ["y", "bucket", "share", *rest])


class Rows:
    """Sparse rows, taken in blocks of about BLOCK features: no column of their size is made beside them."""

    def __init__(self, off: np.ndarray, bucket: np.ndarray, share: np.ndarray) -> None:
        self.off, self.bucket, self.share = off, bucket, share
        cut = np.minimum(np.searchsorted(off, np.arange(0, off[-1] + BLOCK, BLOCK)), len(off) - 1)
        self.blocks = [(int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Each row times w, in single precision, as the shares are."""
        w = w.astype(np.float32)
        z = np.zeros(len(self.off) - 1)
        for a, b in self.blocks:
            lo, hi = self.off[a], self.off[b]
            x = np.append(w[self.bucket[lo:hi]] * self.share[lo:hi], np.float32(0))
            z[a:b] = np.where(np.diff(self.off[a : b + 1]) > 0, np.add.reduceat(x, self.off[a:b] - lo), 0)
        return z

    def back(self, err: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for a, b in self.blocks:
            lo, hi = self.off[a], self.off[b]
            out += np.bincount(self.bucket[lo:hi], np.repeat(err[a:b], np.diff(self.off[a : b + 1])) * self.share[lo:hi], BUCKETS)
        return out


def fit_weights(y: np.ndarray, rows: Rows, held: np.ndarray, class_weight: np.ndarray) -> Model:
    """Class-balanced logistic regression by AdaGrad on the rows that are not held out, then Platt scaling."""
    w, g2, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0
    train = ~held
    balance = np.where(y == 1, 0.5 / max((y[train] == 1).sum(), 1), 0.5 / max((y[train] == 0).sum(), 1)) * train
    for _ in range(STEPS):
        err = (1 / (1 + np.exp(-np.clip(rows.dot(w) + bias, -50, 50))) - y) * balance
        grad = rows.back(err) + DECAY * w
        g2 += grad * grad
        w -= RATE * grad / np.sqrt(g2)
        bias -= RATE * err.sum()
    z = rows.dot(w) + bias
    zs, ys, cw = z[held], y[held], class_weight[held]
    a, b = 1.0, 0.0
    soft = np.where(ys == 1, (ys.sum() + 1) / (ys.sum() + 2), 1 / ((1 - ys).sum() + 2))  # Platt's targets keep the slope finite
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * zs + b, -50, 50)))
        r, v = cw * (p - soft), np.maximum(cw * p * (1 - p), 1e-12)
        hess = np.array([[(v * zs * zs).sum() + 1e-6, (v * zs).sum()], [(v * zs).sum(), v.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, [(r * zs).sum(), r.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return Model(w.astype(np.float32), float(a), float(a * bias + b))


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """y, h (hash of id and text) and text of the sample that the fit reads. Ids, then texts are chosen by hash; only the chosen texts move."""
    y = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and id is not null")
    first = lambda df, k, *order: df.filter(F.col("y") == k).orderBy(*order).limit(rows)
    ids = first(y, 0, F.xxhash64("id"), "id").unionByName(first(y, 1, F.xxhash64("id"), "id"))
    ids = ids.withColumn("label", F.monotonically_increasing_id())
    ids = stage.persisted(ids, "labelled-ids")  # twice rows at most
    mine = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id").withColumn("h", F.xxhash64("id", "text"))
    sizes = mine.select("y", "label", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).filter(F.col("size") <= FIT_BYTES // 16).distinct()
    sizes = stage.persisted(sizes, "labelled-sizes")
    few = first(sizes, 0, "h", "label").unionByName(first(sizes, 1, "h", "label"))
    running = F.sum("size").over(W.partitionBy("y").orderBy("h", "label"))  # of twice rows at most
    few = few.withColumn("total", running).filter(F.col("total") <= FIT_BYTES).select("label", "h")
    return mine.join(F.broadcast(stage.persisted(few, "labelled-texts")), ["label", "h"], "left_semi").dropDuplicates(["label", "h"]).select("y", "h", "text")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model | None:
    """A model from at most rows labelled texts of each class, or None where a class has fewer than 4."""
    labelled = labelled_texts(docs, labels, key, text, label, rows)
    got = map_text(labelled, "text", _sparse_rows, "y int, bucket array<int>, share array<float>, h long", lower=True).toArrow()
    got = got.sort_by([("y", "ascending"), ("h", "ascending")]).combine_chunks()  # rows arrive in any order, the model must not depend on it
    ys = got.column("y").to_numpy().astype(np.int64)
    totals = {r["y"]: r["count"] for r in labels.groupBy(F.col(label).cast("int").alias("y")).count().collect()}
    if min((ys == 0).sum(), (ys == 1).sum()) < 4:
        return None
    buckets, shares = (got.column(c).combine_chunks() for c in ("bucket", "share"))
    del got
    held = np.zeros(len(ys), bool)
    held[::4] = True
    share_of = np.where(ys == 1, totals.get(1, 0) / (ys == 1).sum(), totals.get(0, 0) / (ys == 0).sum())
    return fit_weights(ys.astype(np.float64), Rows(buckets.offsets.to_numpy().astype(np.int64), buckets.values.to_numpy(), shares.values.to_numpy()), held, share_of / share_of.mean())


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, COUNTS, base_failed, probability and kept of each text."""

    def rows(part: pa.RecordBatch, t: Texts) -> pa.RecordBatch:
        counts = base_counts(t)
        failed = base_failed(counts)
        p = np.ones(t.n) if model is None else model.probability(Texts(part.column(text), t.powers, lower=True))
        return pa.record_batch([part.column(key), *(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], [key, *COUNTS, "base_failed", "probability", "kept"])

    kind = dict(docs.dtypes)[key]
    return map_text(docs.select(key, text), text, rows, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the base rules or the classifier reject; the columns stay as they are."""

    def rows(part: pa.RecordBatch, t: Texts) -> pa.RecordBatch:
        good = ~base_failed(base_counts(t))
        if model is not None:
            good &= model.probability(Texts(part.column(text), t.powers, lower=True)) >= threshold
        return part.filter(pa.array(good))

    return map_text(docs, text, rows, docs.schema)
