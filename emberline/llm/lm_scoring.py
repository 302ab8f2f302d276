"""Cross-entropy difference: matched target and background bigram models score every document.

Words are runs of bytes other than ASCII white space, lower-cased for A-Z; every word is told apart, by a 64-bit hash.
The models share one vocabulary, all words of all documents, and one estimator: bigrams, whose first one follows the
start of the text, smoothed by Dirichlet's rule with the model's own unigrams, which are smoothed towards equal shares
of the vocabulary. What a word's followers leave of its mass is the end of the text.

Matched: the target model counts the given documents. All others are the background; where they are more, they are
dealt by hash into as many models (at most MODELS) as bring each near the target's size, and the background loss is the
mean of theirs. What is left of the difference is taken out by scaling the counts of each model to the size of the
smallest. No document is scored by its own counts: they are taken off the model that it belongs to. So documents of one
distribution score alike, whether they are in the target or not.

Per word, loss is -ln p; score is the mean target loss less the mean background loss, so low scores are like the target.
corpus_loss is the mean loss in one model of all documents but the scored one: low for a text that the rest repeats.

Counts are exact. Texts of one model are packed into chunks of about CHUNK_WORDS with a sorted dictionary of their own.
Each chunk sends the sorted hashes of its words and bigrams with their counts, cut into ranges of hashes, a row for each
range; a range is summed over all chunks, and the sums go back to each chunk in the order of its hashes, so without
them. Ranges grow in number with the corpus, not in size; a frequent bigram has one entry in a chunk at most. Only
totals reach the driver.

Texts without words, null and empty ones, get null losses. Very long texts make a chunk of their own. Rows that repeat an
id all count and all get a score; each loses only its own counts, so repeated texts know each other. A null id is never a
target. Without a target, or with nothing beside it, a model without counts gives all words equal shares. An empty table
gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stage
from .textbytes import chunks, mix, Powers, Texts, trimmed

#: Weight of the unigram in the smoothed bigram.
PRIOR = 100.0
#: Background models at most.
MODELS = 8
CHUNK_WORDS = 1 << 20
#: Entries that are summed together, about.
RANGE_ENTRIES = 1 << 20
#: Bits of a chunk's number in its task.
CHUNK_BITS = 20
#: Bytes of target ids that are broadcast at most; beyond, they are joined by a shuffle of the texts.
TARGET_BYTES = 32 << 20
#: Tasks of a shuffle at most.
TASKS = 1 << 15
BLOCK_BYTES = 16 << 20
_FIRST, _SECOND = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25))
_START = np.uint64(0x8CB92BA72F3D8DD7)
_ONE = np.uint64(1)


def _planes(a: np.ndarray) -> bytes:
    """The bytes of a, all first bytes before all second ones: equal bytes stand together for the compression."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _values(planes: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _small(planes: bytes) -> bytes:
    """Compressed by entropy, which the shuffle's own compression does not do."""
    return pa.compress(planes, "zstd", asbytes=True)


def _large(small: bytes, size: int) -> bytes:
    return pa.decompress(small, size, "zstd", asbytes=True)


def _sorted_planes(a: np.ndarray) -> bytes:
    """The same for an ascending column, as differences."""
    return _planes(np.diff(a, prepend=a.dtype.type(0)))


def _sorted_values(planes: bytes) -> np.ndarray:
    return np.cumsum(_values(planes, "<u8"), dtype=np.uint64)


class _Held:
    """Texts of one model that wait for their chunk."""

    def __init__(self) -> None:
        self.ids: list = []
        self.seqs: list[np.ndarray] = []
        self.words = 0

    def add(self, key, seq: np.ndarray) -> None:
        self.ids.append(key)
        self.seqs.append(seq)
        self.words += len(seq)


def _packed(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, number = Powers(), {}, TaskContext.get().partitionId() << CHUNK_BITS

        def out(model: int, rows: _Held) -> pa.RecordBatch:
            nonlocal number
            number += 1
            word, seq = np.unique(np.concatenate(rows.seqs), return_inverse=True)
            sizes = np.array([len(s) for s in rows.seqs], np.int32)
            lists = [pa.array([list(x)], pa.list_(k)) for x, k in ((rows.ids, kind), (sizes, pa.int32()))]
            totals = [pa.array([int(x)], pa.int64()) for x in (sizes.sum(dtype=np.int64), (sizes > 0).sum())]
            blobs = [pa.array([x], pa.binary()) for x in (_sorted_planes(word), _planes(seq.astype("<u4")))]
            return pa.record_batch([pa.array([number - 1], pa.int64()), pa.array([model], pa.int32()), *lists, *blobs, *totals], ["chunk", "model", "ids", "sizes", "words", "seq", "n", "texts"])

        for batch in batches:
            for part in chunks(batch, "text"):
                t = Texts(part.column("text"), powers, lower=True)
                word, doc = t.word_hashes()
                off = np.searchsorted(doc, np.arange(t.n + 1))
                for i, (key, model) in enumerate(zip(part.column("id").to_pylist(), part.column("model").to_pylist(), strict=True)):
                    rows = held.setdefault(model, _Held())
                    rows.add(key, word[off[i] : off[i + 1]] & ~_ONE)
                    if rows.words >= CHUNK_WORDS or len(rows.ids) >= CHUNK_WORDS // 8:
                        yield out(model, held.pop(model))
        for model in sorted(held):
            yield out(model, held.pop(model))

    return run


class Chunk:
    """Words and bigrams of a chunk: key, in ascending order, and how often it holds each. Keys of words are odd."""

    def __init__(self, row: dict[str, pa.Scalar]) -> None:
        words, self.size = _sorted_values(row["words"].as_py()), np.asarray(row["sizes"].values, np.int64)
        self.seq = _values(row["seq"].as_py(), "<u4").astype(np.int64)
        n = len(words)
        stop = np.cumsum(self.size)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.before = np.empty_like(self.seq)
        self.before[1:] = self.seq[:-1]
        self.before[(stop - self.size)[self.size > 0]] = n  # the start
        pair, self.at = np.unique(self.before * (n + 1) + self.seq, return_inverse=True)
        h = np.append(words, _START)
        key = np.concatenate([words | _ONE, mix(h[pair // (n + 1)] * _FIRST + words[pair % (n + 1)] * _SECOND) & ~_ONE])
        self.order = np.argsort(key)
        self.key = key[self.order]
        self.count = np.concatenate([np.bincount(self.seq, minlength=n), np.bincount(self.at, minlength=len(pair))])[self.order]
        self.n_words = n

    def in_place(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns for the ordered keys, as columns for the words and for the bigrams."""
        out = np.empty_like(totals)
        out[:, self.order] = totals
        return out[:, : self.n_words], out[:, self.n_words :]

    def own(self, what: np.ndarray) -> np.ndarray:
        """For each word of the chunk, how often its text holds the same what."""
        top = int(what.max(initial=0)) + 1
        _, at, n = np.unique(self.doc * top + what, return_inverse=True, return_counts=True)
        return n[at]


def _row(batch: pa.RecordBatch | pa.Table, k: int) -> dict[str, pa.Scalar]:
    return {c: batch.column(c)[k] for c in batch.schema.names}


def _sent(ranges: int):
    """Entries of each chunk: keys and counts, a row for each range that it has some in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = Chunk(_row(batch, k))
                into = ((c.key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cut = np.searchsorted(into, np.arange(ranges + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cut))
                for lo in range(0, len(full), 256):
                    some = full[lo : lo + 256]
                    keys = [_small(_sorted_planes(c.key[cut[r] : cut[r + 1]])) for r in some]
                    counts = [_small(_planes(c.count[cut[r] : cut[r + 1]].astype("<u4"))) for r in some]
                    sizes = pa.array(np.diff(cut)[some], pa.int64())
                    m = len(some)
                    yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([batch.column("chunk")[k].as_py()] * m, pa.int64()), pa.array([batch.column("model")[k].as_py()] * m, pa.int32()), sizes, pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["range", "chunk", "model", "size", "keys", "counts"])

    return run


def _summed(models: int):
    """For each chunk, in the order of its keys: what the other chunks hold of them in each model. And the range's words."""

    def run(t: pa.Table) -> pa.Table:
        sizes = t.column("size").to_pylist()
        keys = [_sorted_values(_large(k.as_py(), 8 * n)) for k, n in zip(t.column("keys"), sizes, strict=True)]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        edge = np.cumsum([0, *sizes])
        total = np.zeros((models, len(distinct)), np.int64)
        counts = [_values(_large(c.as_py(), 4 * n), "<u4") for c, n in zip(t.column("counts"), sizes, strict=True)]
        for i, m in enumerate(t.column("model").to_pylist()):
            total[m, at[edge[i] : edge[i + 1]]] += counts[i]
        blobs, widths = [], []
        for i, m in enumerate(t.column("model").to_pylist()):
            others = total[:, at[edge[i] : edge[i + 1]]]  # a copy; the chunk knows its own counts
            others[m] -= counts[i]
            others = others.ravel()
            others = others.astype("<u4") if others.max() < 1 << 32 else others.astype("<i8")
            blobs.append(_small(_planes(others)))
            widths.append(others.itemsize)
        words = np.zeros(len(keys), np.int64)
        words[0] = np.count_nonzero(distinct & _ONE)
        return pa.table({"chunk": t.column("chunk"), "range": t.column("range"), "keys": t.column("size"), "width": pa.array(widths, pa.int32()), "totals": pa.array(blobs, pa.binary()), "words": pa.array(words)})

    return run


def _totals(c: Chunk, model: int, t: pa.Table, models: int) -> np.ndarray:
    """The counts of a chunk's keys in all chunks, a row for each model, from the sums that came back."""
    cols = []
    for k in np.argsort(t.column("range").to_numpy()):
        n, width, blob = (t.column(c)[int(k)].as_py() for c in ("keys", "width", "totals"))
        cols.append(_values(_large(blob, width * n * models), "<u4" if width == 4 else "<i8").astype(np.int64).reshape(models, n))
    out = np.concatenate(cols, axis=1) if cols else np.zeros((models, 0), np.int64)
    out[model] += c.count
    return out


def losses(c: Chunk, totals: np.ndarray, model: int, sizes: np.ndarray, texts: np.ndarray, vocabulary: int) -> np.ndarray:
    """Loss of each word of the chunk in each model, and in one of all documents. sizes and texts: of the models, in
    words and in texts with words."""
    words, pairs = c.in_place(np.concatenate([totals, totals.sum(axis=0, keepdims=True)]))
    least = sizes[sizes > 0].min(initial=np.iinfo(np.int64).max)
    sizes, texts = np.append(sizes, sizes.sum()), np.append(texts, texts.sum())
    last = len(sizes) - 1
    own_pair, own_word, own_size = c.own(c.at), c.own(c.seq), c.size[c.doc]
    own_before = np.ones(len(c.seq), np.int64)  # the start: one
    later = c.before < c.n_words
    own_before[later] = own_word[np.flatnonzero(later) - 1]
    out = np.empty((len(sizes), len(c.seq)))
    for m in range(len(sizes)):
        scale, mine = least / sizes[m] if sizes[m] and m < last else 1.0, m in (model, last)
        history = np.append(words[m], texts[m])[c.before] - mine * own_before
        word = (scale * (words[m][c.seq] - mine * own_word) + 1) / (scale * (sizes[m] - mine * own_size) + vocabulary + 1)
        out[m] = -np.log((scale * (pairs[m][c.at] - mine * own_pair) + PRIOR * word) / (scale * history + PRIOR))
    return out


def background_models(target_bytes: int, other_bytes: int) -> int:
    """How many models of about the target's size the other documents make."""
    return max(1, min(MODELS, round(other_bytes / target_bytes))) if target_bytes else 1


def score_documents(docs: DataFrame, target_ids: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, target_loss, background_loss, score and corpus_loss. target_ids: one column, the ids of the target."""
    kind = dict(docs.dtypes)[key]
    target = target_ids.toDF("id").filter("id is not null").distinct().withColumn("target", F.lit(True))
    target = stage.persisted(target, "target")
    if (target.agg(F.sum(8 + F.octet_length(F.col("id").cast("string")))).first()[0] or 0) <= TARGET_BYTES:
        target = F.broadcast(target)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    flagged = rows.join(target, "id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    sized = rows.select("id", F.octet_length("text").alias("bytes")).join(target, "id", "left").groupBy(F.coalesce("target", F.lit(False)).alias("target"))
    sizes = {r["target"]: r["bytes"] or 0 for r in sized.agg(F.sum("bytes").alias("bytes")).collect()}
    models = 1 + background_models(sizes.get(True, 0), sizes.get(False, 0))
    dealt = F.when(F.col("target"), 0).otherwise(1 + F.pmod(F.xxhash64("id", "text"), F.lit(models - 1)))
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = f"chunk long, model int, ids array<{kind}>, sizes array<int>, words binary, seq binary, n long, texts long"
    packed = flagged.select("id", "text", dealt.cast("int").alias("model")).mapInArrow(trimmed(_packed(arrow)), schema)
    buckets = min(sum(sizes.values()) // (4 * CHUNK_WORDS) + 1, TASKS)  # about a chunk or two in each
    packed = stage.bucketed(packed, "sequences", "chunk", buckets, BLOCK_BYTES)
    counted = {r["model"]: r for r in packed.groupBy("model").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).collect()}
    n, texts = (np.array([counted[m][c] if m in counted else 0 for m in range(models)], np.int64) for c in ("n", "texts"))

    chunk = packed.select("chunk", "model", "ids", "sizes", "words", "seq")
    ranges = int(n.sum()) // RANGE_ENTRIES + 1
    sent = chunk.mapInArrow(trimmed(_sent(ranges)), "range int, chunk long, model int, size long, keys binary, counts binary")
    summed = sent.repartitionById(min(ranges, TASKS), "range").groupBy("range").applyInArrow(_summed(models), "chunk long, range int, keys long, width int, totals binary, words long")
    summed = stage.persisted(summed, "sums", BLOCK_BYTES)
    vocabulary = summed.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _row(left, 0)
        c, model = Chunk(row), row["model"].as_py()
        loss = losses(c, _totals(c, model, right, models), model, n, texts, vocabulary)
        own, other, every = (np.bincount(c.doc, x, len(c.size)) / np.maximum(c.size, 1) for x in (loss[0], loss[1:-1].mean(axis=0), loss[-1]))
        columns = {"target_loss": own, "background_loss": other, "score": own - other, "corpus_loss": every}
        return pa.table({"id": pa.array(row["ids"].as_py(), arrow), "n_tokens": pa.array(c.size), **{k: pa.array(v, mask=c.size == 0) for k, v in columns.items()}})

    return chunk.groupBy("chunk").cogroup(summed.drop("words").groupBy("chunk")).applyInArrow(scored, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double, corpus_loss double")
