"""Removal of long repeated byte strings, by suffix sorting of bounded groups with bucket-pointer refinement.

Every byte covered by a WIDTH-byte string that also starts anywhere else goes, the same text included; overlaps count
and strings are judged on the input. Texts are UTF-8; null is empty; strings never reach across texts.

1. Each WIDTH-byte window belongs to the smallest hash of its GRAM-byte grams. Consecutive windows with one such value
   form a stretch; equal windows have equal values, so they meet in one group whatever texts they are in.
2. A group with a single stretch holds nothing that repeats, unless the value stands in two places of it. If all
   stretches of a group are the same bytes, all their windows repeat. Only groups of differing stretches, or of such
   that may repeat inside, need their bytes: one copy of each distinct stretch. Stretches are told apart by a 64-bit
   digest inside their group, whose value is another 64-bit hash.
3. Those are suffix-sorted: buckets of 8-byte prefixes are refined by sorting on the bucket identifiers 8, 16, 32, ...
   bytes further on, each round reusing the buckets of the one before, up to WIDTH bytes. Windows that still share a
   bucket repeat. Groups of up to GROUP_BYTES distinct bytes are sorted in batches of whole groups.
4. A larger group goes through the same refinement as a table of suffixes: each round joins a suffix with the bucket of
   the one further on, groups by the two, and takes the smallest suffix of a group as its bucket, so no group has to
   meet in one task. The answer is the same.

The broadcast bit set has a fixed size and only spares shipping; joins decide. Rows that repeat are each other's
copies, so both lose the repeated bytes. A null id is kept as null; rows that share an id are told apart by a hash of
the text. Very long texts are read whole, one at a time. An empty table gives no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stage
from .decontamination import _in, bit_set
from .textbytes import chunks, map_text, mix, Powers, Texts, trimmed

GRAM = 24
#: Distinct bytes of a group that is sorted in one task.
GROUP_BYTES = 8 << 20
#: Bytes that are suffix-sorted together, whole groups at a time.
SORT_BYTES = 1 << 20


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, from minima of blocks read forwards and backwards."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _inner(h: np.ndarray, value: np.ndarray, start: np.ndarray, count: np.ndarray, reach: int) -> np.ndarray:
    """Whether a stretch holds its value in two places. A gram lies in reach windows, so longer stretches do."""
    views = np.lib.stride_tricks.sliding_window_view(h, reach)
    out = count > reach
    for i in range(0, len(value), 2048):
        j = slice(i, i + 2048)
        first, last = (views[at] == value[j, None] for at in (start[j], start[j] + count[j] - 1))
        apart = first.argmax(axis=1) + start[j] != last.argmax(axis=1) + start[j] + count[j] - 1
        out[j] |= (first.sum(axis=1) > 1) | (last.sum(axis=1) > 1) | apart
    return out


def stretches(t: Texts, width: int, gram: int, inner: bool = False) -> tuple[np.ndarray, ...]:
    """Value, text, first window and number of windows of each stretch; and whether windows may repeat inside it."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))
    if len(t.raw) < width:
        return none
    c = t.prefix_hash()
    h = (c[gram:] - c[:-gram]) * t.powers.down[: len(c) - gram]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = _smallest(h, width - gram + 1)
    count = np.maximum(np.diff(t.off) - width + 1, 0)
    inside = np.zeros(len(t.raw) + 1, np.int32)
    np.add.at(inside, t.off[:-1][count > 0], 1)
    np.add.at(inside, t.off[:-1][count > 0] + count[count > 0], -1)
    at = np.flatnonzero(np.cumsum(inside[: len(least)]) > 0)
    if not len(at):
        return none
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (np.diff(at) > 1)
    first_of_text = np.zeros(len(t.raw) + 1, bool)
    first_of_text[t.off[:-1]] = True
    new |= first_of_text[at]
    first = np.flatnonzero(new)
    found = value[first], np.searchsorted(t.off, at[first], "right") - 1, at[first], np.diff(np.append(first, len(at)))
    held = _inner(h, found[0], found[2], found[3], width - gram + 1) if inner else none[-1]
    return mix(found[0]), *found[1:], held  # minima are small numbers; mixed, they spread over the bit set


def _digests(t: Texts, start: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    view, digest = memoryview(np.ascontiguousarray(t.raw)), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), (start + count + width - 1).tolist(), strict=True)), np.uint64, len(start))


def _table(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """A row for each stretch."""

    def rows(part: pa.RecordBatch, t: Texts) -> pa.RecordBatch | None:
        value, doc, start, count, inner = stretches(t, width, gram, inner=True)
        if not len(value):
            return None
        took = pa.array(doc)
        return pa.record_batch([pa.array(value.view(np.int64)), pa.array(_digests(t, start, count, width).view(np.int64)), part.column("id").take(took), part.column("mark").take(took), pa.array(start - t.off[doc]), pa.array(count, pa.int32()), pa.array(inner)], ["h", "digest", "id", "mark", "start", "count", "inner"])

    return map_text(docs, "text", rows, "h long, digest long, id long, mark long, start long, count int, inner boolean")


def _bytes(docs: DataFrame, bits: np.ndarray, width: int, gram: int) -> DataFrame:
    """h, digest and bytes of the stretches whose value is in the bit set; within a task mostly once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for batch in batches:
            for part in chunks(batch, "text"):
                t = Texts(part.column("text"), powers)
                value, _, start, count, _ = stretches(t, width, gram)
                use = _in(bits, value)
                value, start, count = value[use], start[use], count[use]
                digest = _digests(t, start, count, width)
                if len(seen) > 150_000:
                    seen = set()
                out = []
                for i, key in enumerate(zip(value.view(np.int64).tolist(), digest.view(np.int64).tolist(), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        out.append((*key, t.raw[start[i] : start[i] + count[i] + width - 1].tobytes()))
                if out:
                    h, d, b = zip(*out, strict=True)
                    yield pa.record_batch([pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(b, pa.binary())], ["h", "digest", "bytes"])

    return docs.select("text").mapInArrow(trimmed(run), "h long, digest long, bytes binary")


def repeated_windows(pieces: list[bytes], width: int) -> np.ndarray:
    """For each byte of the joined pieces, whether a width-byte string begins there that begins elsewhere too."""
    size = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
    n = len(raw) - 8
    left = np.repeat(np.cumsum(size), size) - np.arange(n)  # bytes up to the end of the piece
    depth = min(8, width)
    code = np.zeros(n, np.uint64)
    for k in range(depth):
        code = (code << np.uint64(8)) | raw[k : k + n]
    bucket = np.empty(n, np.int64)  # place of the first suffix of the same bucket
    live = np.flatnonzero(left >= depth)
    bucket[left < depth] = n + np.flatnonzero(left < depth)  # too short: on its own, and never asked for

    def refine(live: np.ndarray, key: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Gives suffixes in live their new buckets; returns those that still share one. base: places of old buckets."""
        order = np.argsort(key)
        s = key[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        at = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        old = base[order]
        begin = np.ones(len(s), bool)
        begin[1:] = old[1:] != old[:-1]
        bucket[live[order]] = old + at - np.maximum.accumulate(np.where(begin, np.arange(len(s)), 0))
        last = np.append(first[1:], True)
        return live[order[~(first & last)]]

    live = refine(live, code[live], np.zeros(len(live), np.int64))
    while depth < width and len(live):
        step = min(depth, width - depth)
        ends = live[left[live] < depth + step]
        bucket_before = bucket.copy() if len(ends) else bucket
        live = live[left[live] >= depth + step]
        rank = np.unique(bucket_before[live + step], return_inverse=True)[1]
        own = bucket_before[live]
        new_live = refine(live, own * np.int64(len(live) + 1) + rank, own)
        bucket[ends] = n + ends
        live, depth = new_live, depth + step
    out = np.zeros(n, bool)
    out[live] = True
    return out


def _sorted_groups(width: int):
    """Ranges of repeated windows of each distinct stretch; rows come in order of h and digest."""

    def solve(h: list[int], d: list[int], b: list[bytes]) -> pa.RecordBatch:
        hit = repeated_windows(b, width)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        a, e = edge[::2], edge[1::2]
        off = np.cumsum([0, *map(len, b)])
        owner = np.searchsorted(off, a, "right") - 1
        cut = pa.array(np.searchsorted(owner, np.arange(len(b) + 1)), pa.int32())
        return pa.record_batch([pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(a - off[owner], pa.int32())), pa.ListArray.from_arrays(cut, pa.array(e - a, pa.int32()))], ["h", "digest", "first", "number"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: list[int] = []
        d: list[int] = []
        b: list[bytes] = []
        held = 0
        for batch in batches:
            for x, y, z in zip(*(batch.column(c).to_pylist() for c in ("h", "digest", "bytes")), strict=True):
                if h and x == h[-1] and y == d[-1]:
                    continue  # another copy of the same stretch
                if held >= SORT_BYTES and x != h[-1]:
                    yield solve(h, d, b)
                    h, d, b, held = [], [], [], 0
                h.append(x)
                d.append(y)
                b.append(z)
                held += len(z)
        if h:
            yield solve(h, d, b)

    return run


def _suffixes(depth: int):
    """A row for each suffix of at least depth bytes, those of a piece in order: its piece, place, bytes and first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data in zip(batch.column("piece").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                for a in range(0, len(data) - depth + 1, 1 << 17):
                    n = min(1 << 17, len(data) - depth + 1 - a)
                    raw = np.frombuffer(data, np.uint8, n + depth - 1, a)
                    code = np.zeros(n, np.uint64)
                    for k in range(depth):
                        code = (code << np.uint64(8)) | raw[k : k + n]
                    place = np.arange(a, a + n)
                    yield pa.record_batch([pa.array(np.full(n, piece)), pa.array(place, pa.int32()), pa.array(len(data) - place, pa.int32()), pa.array(code.view(np.int64))], ["piece", "place", "room", "bucket"])

    return run


def refined(pieces: DataFrame, width: int) -> DataFrame:
    """piece and place of each repeated window among pieces (piece, bytes), refined as tables.

    Suffixes are numbered in order inside a piece, so the one k bytes further on has a number greater by k. A suffix
    whose bucket holds no other is dropped: no window that begins with it, or reaches it, repeats.
    """
    depth = min(8, width)
    rows = pieces.mapInArrow(trimmed(_suffixes(depth)), "piece long, place int, room int, bucket long").withColumn("suffix", F.monotonically_increasing_id())
    rows = stage.persisted(rows, "suffixes")

    def shared(df: DataFrame, keys: list[str]) -> DataFrame:
        groups = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("suffix").alias("first")).filter("n > 1")
        kept = df.join(groups, keys).select("suffix", "room", F.col("first").alias("bucket"))
        return stage.persisted(kept, "buckets")

    live = shared(rows.select("suffix", "room", "bucket"), ["bucket"])
    while depth < width:
        step = min(depth, width - depth)
        later = live.select((F.col("suffix") - step).alias("suffix"), F.col("bucket").alias("later"))
        live = shared(live.filter(F.col("room") >= depth + step).join(later, "suffix"), ["bucket", "later"])
        depth += step
    return rows.select("suffix", "piece", "place").join(live.select("suffix"), "suffix").select("piece", "place")


def _applied(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                out = []
                for text, first, number in zip(*(part.column(c).to_pylist() for c in ("text", "first", "number")), strict=True):
                    raw = np.frombuffer((text or "").encode(), np.uint8)
                    change = np.zeros(len(raw) + 1, np.int64)
                    if first:
                        a = np.array(first)
                        np.add.at(change, a, 1)
                        np.add.at(change, a + np.array(number) + width - 1, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    out.append((len(raw), int(gone.sum()), edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), raw[~gone].tobytes()))
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)]
                yield pa.record_batch([part.column("id"), *cols], ["id", "n_bytes", "n_removed", "span_start", "span_bytes", "kept"])

    return run


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 200) -> DataFrame:
    """id, n_bytes, n_removed, span_start and span_bytes (of maximal removed runs), kept (bytes)."""
    gram = max(1, min(GRAM, width // 4))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = rows.withColumn("mark", F.xxhash64("text"))
    table = stage.persisted(_table(marked, width, gram), "stretches")
    groups = table.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.col("count") + (width - 1)).alias("bytes"), ((F.min("digest") != F.max("digest")) | F.max("inner")).alias("mixed")).filter("n > 1 or mixed")
    groups = stage.persisted(groups.select("h", "mixed", (F.col("bytes") > GROUP_BYTES).alias("wide")), "groups")
    found = stage.persisted(table.join(groups.select("h", "mixed"), "h"), "repeated")
    mixed = groups.filter("mixed").select("h")
    held = stage.persisted(_bytes(rows, bit_set(mixed), width, gram).join(mixed, "h"), "stretch-bytes")

    # copies do not count: what is sorted is one of each
    wide = found.join(groups.filter("mixed and wide").select("h"), "h", "left_semi").select("h", "digest", "count").distinct()
    large = stage.persisted(wide.groupBy("h").agg(F.sum(F.col("count") + (width - 1)).alias("bytes")).filter(F.col("bytes") > GROUP_BYTES).select("h"), "large-groups")
    some_large = not large.isEmpty()
    small = held.join(large, "h", "left_anti") if some_large else held
    answers = small.repartition("h").sortWithinPartitions("h", "digest").mapInArrow(trimmed(_sorted_groups(width)), "h long, digest long, first array<int>, number array<int>")
    if some_large:
        pieces = stage.persisted(held.join(large, "h", "left_semi").dropDuplicates(["h", "digest"]).withColumn("piece", F.monotonically_increasing_id()), "pieces")
        windows = refined(pieces.select("piece", "bytes"), width).groupBy("piece").agg(F.collect_list("place").alias("first"))
        answers = answers.unionByName(windows.join(pieces.select("piece", "h", "digest"), "piece").select("h", "digest", "first", F.transform("first", lambda _: F.lit(1)).alias("number")))
    answers = stage.persisted(answers, "answers")

    copies = found.filter("mixed").groupBy("h", "digest").agg(F.count("*").alias("copies"))
    asked = found.filter("mixed").join(copies, ["h", "digest"]).join(answers, ["h", "digest"], "left")
    whole = F.col("copies") > 1
    parts = asked.select("id", "mark", F.explode(F.when(whole, F.array(F.struct("start", "count"))).otherwise(F.zip_with("first", "number", lambda a, b: F.struct((F.col("start") + a).alias("start"), b.alias("count"))))).alias("r"))
    ranges = found.filter("not mixed").select("id", "mark", "start", "count").unionByName(parts.select("id", "mark", F.col("r.start").alias("start"), F.col("r.count").alias("count")))
    spans = ranges.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set(F.struct("start", "count")).alias("r"))
    spans = spans.select("_id", "_mark", F.col("r.start").alias("first"), F.col("r.count").alias("number"))
    joined = marked.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("id", "text", "first", "number")
    return joined.mapInArrow(trimmed(_applied(width)), "id long, n_bytes long, n_removed long, span_start array<long>, span_bytes array<long>, kept binary")
