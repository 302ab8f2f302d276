"""Near duplicates by bottom-k sketches, with links confirmed on full shingle sets.

Words are runs of bytes other than ASCII white space, lower-cased for A-Z. A document's set holds its distinct n-word
shingles; with fewer words, its whole sequence. Two documents are linked if |A and B| * den >= num * |A or B|. One hash
function gives all sketches: the k smallest hashes of a set.

1. Equal word sequences (128-bit digest) are one class with a number of its own. All steps work on classes; ids come in
   at the end, so an id that stands in rows of several texts takes part with each of them.
2. Inverted lists: of the LIST_VALUES smallest hashes, each class enters the lists of the rarest ones only, as many as
   are needed for two linked classes to share one. Up to 25 shingles this is the exact prefix bound; beyond, it
   assumes an overlap of 0.4 of the listed values where at least 0.8 * 32 are expected, which fails with a
   probability under 1e-6 for a link at the threshold.
3. Every class is compared with one class of each of its lists, the one whose listed values stand in most other lists:
   an original, whose values its copies share, rather than a copy with values of its own. Pairs grow as the members.
4. Lists whose members are then still in several components are compared inside, only across components, in blocks of
   BLOCK classes, so that neither a list nor its pairs meet in one task. Sketches of SKETCH values decide what is
   passed on: sets of up to SKETCH shingles exactly, larger ones with a margin of six standard errors.
5. Each pair that passes is confirmed on the full sets.

No list or group is capped. Null and empty texts have no words: they are linked with nothing. Rows that repeat an id
count as one document: their classes are linked with each other, so the document is linked if any of its texts is. A
null id stays alone. Very long texts are read whole, one at a time. An empty table gives no rows. Other columns are not
read, whatever their names; keep_one passes them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.graph import components

from . import stage
from .textbytes import chunks, distinct_by_doc, lists, map_text, Powers, shingles, Texts, trimmed

LIST_VALUES = 32
SKETCH = 256
#: An estimate passes from this share of the threshold: six standard errors of a sketch of SKETCH values below it.
MARGIN = 0.8
BLOCK = 1024


def _sets(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    word, doc = t.word_hashes()
    return distinct_by_doc(*shingles(word, doc, n, t.n))


def _smallest(h: np.ndarray, d: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest values of each text; h sorted by text and value."""
    first = np.searchsorted(d, np.arange(n_docs))
    keep = np.arange(len(h)) - first[d] < k
    return h[keep], d[keep]


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def base_rows(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """id, mark (hash of the text), n_shingles, digest (null without words) and the listed values."""

    def rows(part: pa.RecordBatch, t: Texts) -> pa.RecordBatch:
        h, d = _sets(t, n)
        count = np.bincount(d, minlength=t.n)
        digest = [hashlib.blake2b(b" ".join(t.piece(i).split()), digest_size=16).digest() if count[i] else None for i in range(t.n)]
        s, sd = _smallest(h, d, t.n, LIST_VALUES)
        return pa.record_batch([part.column("id"), part.column("mark"), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), lists(_short(s), sd, t.n, pa.int32())], ["id", "mark", "n_shingles", "digest", "v"])

    return map_text(_texts(docs, key, text), "text", rows, "id long, mark long, n_shingles long, digest binary, v array<int>", lower=True)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def _prefix(num: int, den: int):
    """How many of the rarest listed values a class of n shingles enters."""
    n, m = F.col("n_shingles"), F.least(F.col("n_shingles"), F.lit(LIST_VALUES))
    exact = n - F.ceil(n * num / den) + 1
    return F.when(n <= LIST_VALUES * num // den, exact).otherwise(m - F.floor(m * 0.4 * (num / den) / 0.8) + 1)


def inverted_lists(reps: DataFrame, num: int, den: int) -> DataFrame:
    """v, rep and weight: members of the lists that have two or more; weight: sizes of all lists of its values."""
    values = reps.select("rep", "n_shingles", F.explode("v").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    held = values.join(common, "v").groupBy("rep").agg(F.first("n_shingles").alias("n_shingles"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held"))
    single = F.least(F.col("n_shingles"), F.lit(LIST_VALUES)) - F.size("held")
    room = F.greatest(_prefix(num, den) - single, F.lit(0)).cast("int")
    weight = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    entered = held.withColumns({"room": room, "weight": weight}).filter("room > 0").select("rep", "weight", F.explode(F.slice("held", F.lit(1), F.col("room"))).alias("e"))
    return entered.select("rep", "weight", F.col("e.v").alias("v"))


def _estimates(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Jaccard estimates from the union's sketch: the share of its SKETCH smallest values that both hold."""
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = x.view(np.uint32), y.view(np.uint32)
        union = np.union1d(x, y)
        whole = len(x) < SKETCH and len(y) < SKETCH
        union = union if whole else union[:SKETCH]
        out[i] = len(np.intersect1d(np.intersect1d(x, y), union)) / max(len(union), 1)
    return out


def linked(ta: Texts, tb: Texts, n: int, num: int, den: int) -> np.ndarray:
    """Whether text i of ta and text i of tb are linked, on their full sets."""
    (ha, da), (hb, db) = _sets(ta, n), _sets(tb, n)
    h, d = np.concatenate([ha, hb]), np.concatenate([da, db])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    both = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=ta.n)
    union = np.bincount(d, minlength=ta.n) - both
    return (both * den >= num * union) & (both > 0)


def confirm(pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Edges a, b among rows of a, b, text_a, text_b, s_a and s_b."""
    low = MARGIN * num / den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch, "text_a"):
                sa, sb = ([np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in part.column(c)] for c in ("s_a", "s_b"))
                part = part.filter(pa.array(_estimates(sa, sb) >= low))
                for few in chunks(part, "text_b"):
                    ok = linked(Texts(few.column("text_a"), powers, True), Texts(few.column("text_b"), powers, True), n, num, den)
                    yield few.select(["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "text_a", "text_b", "s_a", "s_b").mapInArrow(trimmed(run), "a long, b long")


def _with_sketch(df: DataFrame, n: int) -> DataFrame:
    """Adds s, the sketch of SKETCH values, and n_shingles."""
    names = df.columns

    def rows(part: pa.RecordBatch, t: Texts) -> pa.RecordBatch:
        h, d = _sets(t, n)
        s, sd = _smallest(h, d, t.n, SKETCH)
        return pa.record_batch([*part.columns, lists(_short(s), sd, t.n, pa.int32()), pa.array(np.bincount(d, minlength=t.n), pa.int32())], [*names, "s", "size"])

    schema = ", ".join(f"{c} {k}" for c, k in df.dtypes) + ", s array<int>, size int"
    return map_text(df, "text", rows, schema, lower=True)


def _across(num: int, den: int):
    """Pairs inside runs of equal (v, i, j) whose components differ and whose sketches may be linked."""
    tau = num / den

    def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of sets[left] and sets[right]."""
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        value, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        place = np.full(len(value), -1)
        place[shared] = np.arange(len(shared))
        use = place[at] >= 0
        own, col = own[use], place[at][use]
        both = np.zeros((len(left), len(right)), np.float32)
        step = max(1, (16 << 20) // (4 * max(len(sets), 1)))
        order = np.argsort(col, kind="stable")
        own, col = own[order], col[order]
        for c in range(0, len(shared), step):  # a bounded part of the values at a time
            lo, hi = np.searchsorted(col, [c, c + step])
            m = np.zeros((len(sets), min(step, len(shared) - c)), np.float32)
            m[own[lo:hi], col[lo:hi] - c] = 1
            both += m[left] @ m[right].T
        return both

    def group(rep: np.ndarray, comp: np.ndarray, side: np.ndarray, size: np.ndarray, sketch: list[np.ndarray], earlier: list[np.ndarray], one: bool) -> list[np.ndarray]:
        """one: all pairs of the run; else those between the two sides. Pairs that meet in an earlier list are left to it."""
        left, right = (np.arange(len(rep)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if not len(left) or not len(right) or comp.min() == comp.max():
            return []
        both = common(sketch, left, right)
        na, nb = size[left][:, None], size[right][None, :]
        largest = np.maximum(na, nb)
        whole = largest <= SKETCH
        ok = np.where(whole, both >= (tau - 0.005) * (na + nb - both), both >= MARGIN * tau * SKETCH) & (comp[left][:, None] != comp[right][None, :])
        ok &= np.minimum(na, nb) >= tau * largest
        if ok.any():
            ok &= common(earlier, left, right) == 0
        x, y = np.nonzero(ok)
        a, b = rep[left[x]], rep[right[y]]
        keep = a < b if one else a != b
        return [np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            if not rows.num_rows:
                return
            key = np.stack([rows.column(c).to_numpy() for c in ("v", "i", "j")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            rep, comp, side, size = (rows.column(c).to_numpy() for c in ("rep", "comp", "side", "size"))
            col = rows.column("s").combine_chunks()
            flat, off = col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
            entered = rows.column("entered").combine_chunks()
            listed, at = entered.flatten().to_numpy(), np.concatenate([[0], np.cumsum(entered.value_lengths().to_numpy())])
            found = []
            for a, b in zip([0, *cut], [*cut, rows.num_rows], strict=True):
                if b - a > 1:
                    earlier = [x[x < key[0, a]] for k in range(a, b) for x in (listed[at[k] : at[k + 1]],)]
                    found += group(rep[a:b], comp[a:b], side[a:b], size[a:b], [flat[off[k] : off[k + 1]] for k in range(a, b)], earlier, key[1, a] == key[2, a])
            if found:
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in ("v", "i", "j")]
            same = np.ones(batch.num_rows, bool)
            for c, x in zip(("v", "i", "j"), last, strict=True):
                same &= batch.column(c).to_numpy() == x
            tail = int(np.argmax(same))  # rows are sorted: the last run begins here
            if tail:
                yield from flush(pa.Table.from_batches([*held, batch.slice(0, tail)]))
                held = [batch.slice(tail)]
            elif held and all(held[-1].column(c)[0].as_py() == x for c, x in zip(("v", "i", "j"), last, strict=True)):
                held.append(batch)
            else:
                if held:
                    yield from flush(pa.Table.from_batches(held))
                held = [batch]
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """id, n_shingles and component_id, the smallest id that links lead to (null for a null id)."""
    base = stage.persisted(base_rows(docs, key, text, n), "shingles")
    classes = base.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("first"))
    classes = stage.persisted(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = stage.persisted(base.join(classes, "digest").filter("id = first").select("rep", "id", "mark", "n_shingles", "v").dropDuplicates(["rep"]), "representatives")
    repeats = not base.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty()
    entered = stage.persisted(inverted_lists(reps, num, den), "lists")

    pivots = entered.groupBy("v").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("m"), F.count("*").alias("members")).filter("members > 1").select("v", (-F.col("m.r")).alias("pivot"))
    star = stage.persisted(entered.join(pivots, "v").filter("rep <> pivot").groupBy("rep").agg(F.collect_set("pivot").alias("pivots")), "stars")
    needed = entered.join(pivots, "v").select("rep").distinct().join(star, "rep", "left")
    wanted = _texts(docs, key, text).join(needed.join(reps.select("rep", "id", "mark"), "rep"), ["id", "mark"]).select("rep", "pivots", "text")
    held = stage.persisted(_with_sketch(wanted.dropDuplicates(["rep"]) if repeats else wanted, n), "candidates")
    pivot_side = held.join(star.select(F.explode("pivots").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("b"), F.col("text").alias("text_b"), F.col("s").alias("s_b"))
    member_side = held.filter("pivots is not null").select(F.col("rep").alias("a"), F.col("text").alias("text_a"), F.col("s").alias("s_a"), F.explode("pivots").alias("b"))
    edges = stage.persisted(confirm(member_side.join(pivot_side, "b"), n, num, den), "links")
    first = components(edges)

    named = entered.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("v", "rep", F.coalesce("label", "rep").alias("comp"))
    named = stage.persisted(named, "members")
    mixed = named.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).filter("lo <> hi").select("v", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    in_lists = entered.groupBy("rep").agg(F.collect_set("v").alias("entered"))
    open_lists = named.join(mixed, "v").join(held.select("rep", "s", "size").join(in_lists, "rep"), "rep")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    open_lists = open_lists.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = open_lists.select("v", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "rep", "comp", "size", "s", "entered")
    spread = keyed.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")
    maybe = stage.persisted(spread.mapInArrow(trimmed(_across(num, den)), "a long, b long").distinct(), "pairs")
    left = held.select(F.col("rep").alias("a"), F.col("text").alias("text_a"), F.col("s").alias("s_a"))
    right = held.select(F.col("rep").alias("b"), F.col("text").alias("text_b"), F.col("s").alias("s_b"))
    more = stage.persisted(confirm(maybe.join(left, "a").join(right, "b"), n, num, den), "links")
    same = edges.unionByName(more)
    if repeats:
        own = base.filter("id is not null").join(classes, "digest").select("id", "rep")
        several = own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a <> last").select("id", "a")
        same = same.unionByName(own.join(several, "id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct())
    final = first if more.isEmpty() and not repeats else components(same)

    least = final.join(classes, F.col("node") == F.col("rep")).groupBy("label").agg(F.min("first").alias("component_id"))
    named = base.select("id", "n_shingles", "digest").join(classes, "digest", "left").join(final.join(least, "label").select(F.col("node").alias("rep"), "component_id"), "rep", "left")
    named = named.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "first", "id")).alias("component_id"))
    if repeats:  # rows without words go with the others of their id
        whole = named.groupBy("id").agg(F.min("component_id").alias("component_id"))
        named = named.drop("component_id").join(whole.filter("id is not null"), "id", "left")
    return named


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without the members of a group other than the one with the smallest id; the columns stay as they are."""
    found = near_duplicates(docs, key, text, n, num, den)
    gone = stage.persisted(found.filter("id <> component_id").select(F.col("id").alias("__gone")).distinct(), "dropped")
    return docs.join(gone, docs[key].cast("long") == gone["__gone"], "left_anti")
