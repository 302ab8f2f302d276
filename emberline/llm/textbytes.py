"""Vectorised views of an Arrow text column: one byte buffer, its words, and 64-bit hashes of them.

All functions work on chunks of a few MB, so memory in a Python worker is bounded by CHUNK_BYTES or by the
longest single text, whichever is larger. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A 64-bit value for each byte, so that sums of them do not cancel.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse, kept for a task."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))


class Texts:
    """Texts as one buffer. off[i]:off[i + 1] are the bytes of text i."""

    def __init__(self, column: pa.Array, powers: Powers, lower: bool = False) -> None:
        column = pc.fill_null(column, "").cast(pa.large_string())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.raw = raw[off[0] : off[-1]] if len(off) else raw[:0]
        self.off = off - off[0] if len(off) else np.zeros(1, np.int64)
        if lower:
            self.raw = _LOWER[self.raw]
        self.n = len(self.off) - 1
        self.powers = powers

    def piece(self, i: int) -> bytes:
        return self.raw[self.off[i] : self.off[i + 1]].tobytes()

    def prefix_hash(self) -> np.ndarray:
        """c, with span() giving the hash of any byte range from it."""
        self.powers.need(len(self.raw) + 1)
        c = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(_BYTE[self.raw] * self.powers.up[: len(self.raw)], out=c[1:])
        return c

    def span(self, c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((c[end] - c[start]) * self.powers.down[start] + (end - start).astype(np.uint64))

    def word_bounds(self, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each run of bytes other than those between words, ASCII white space by default."""
        solid = ~between[self.raw]
        first = np.ones(len(solid), bool)
        first[1:] = ~solid[:-1]
        last = np.ones(len(solid), bool)
        last[:-1] = ~solid[1:]
        cut = self.off[:-1]
        first[cut[cut < len(solid)]] = True
        last[cut[cut > 0] - 1] = True
        start, end = np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1
        return start, end, np.searchsorted(self.off, start, "right") - 1

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each word."""
        start, end, doc = self.word_bounds()
        return self.span(self.prefix_hash(), start, end), doc


def shingles(word: np.ndarray, doc: np.ndarray, n: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of n words; a text of fewer words gives its whole sequence as one."""
    count = np.bincount(doc, minlength=n_docs)
    if len(word) >= n:
        full = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
        h = np.zeros(len(full), np.uint64)
        for k in range(n):
            h += word[full + k] * _STEP[k]
        d = doc[full]
    else:
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = (count > 0) & (count < n)
    if short.any():
        at = np.flatnonzero(short[doc])
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        part = np.zeros(n_docs, np.uint64)
        np.add.at(part, doc[at], word[at] * _STEP[at - first[doc[at]]])
        h, d = np.concatenate([h, part[short] + count[short].astype(np.uint64)]), np.concatenate([d, np.flatnonzero(short)])
    return mix(h), d


def distinct_by_doc(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, by text and then by hash."""
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow; memory that is free after a task goes back to the system, as idle workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def chunks(batch: pa.RecordBatch, column: str, limit: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about CHUNK_BYTES of text each, one text at least."""
    limit = limit or CHUNK_BYTES
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    i = 0
    while i < len(size):
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def map_text(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch, Texts], pa.RecordBatch | None], schema: str, lower: bool = False, limit: int = 0) -> DataFrame:
    """fn over df in chunks; it gets the rows and the bytes of the column named text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch, text, limit):
                if (out := fn(part, Texts(part.column(text), powers, lower))) is not None:
                    yield out

    return df.mapInArrow(trimmed(run), schema)


def lists(values: np.ndarray, doc: np.ndarray, n_docs: int, kind: pa.DataType) -> pa.Array:
    """An Arrow list for each text from values that are sorted by text."""
    off = np.searchsorted(doc, np.arange(n_docs + 1))
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
