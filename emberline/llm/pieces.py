"""SentencePiece BPE encoding by suffix-array matching, and decoding.

Texts get the dummy prefix and the escaped spaces of the model and are cut where no piece can reach across: before a
run of escaped spaces and around control white space. The distinct parts of a batch are concatenated and indexed by a
suffix array (prefix doubling up to the longest piece); a binary search for every piece gives its range of
occurrences; the occurrences are the edges of a lattice, sorted by end position and relaxed from left to right. An
edge is taken if its piece may follow the last piece of the text before it. Two pieces may follow each other exactly
if merging their characters by score gives the two back; as merges are local, the path found is the BPE result itself.
Characters that end outside every piece become byte pieces.

The parts of a batch are counted once each and remembered in a task, so what is concatenated and indexed is the batch
text without what was indexed before. An index holds INDEX_CHARS characters, or one part where that is longer: a text
without a space is such a part, and memory and steps grow with it, as its pieces may depend on each other throughout.

Null texts give null ids; an empty text gives none. Decoding gives the text back, but for the escape character U+2581
in a text, which reads as a space, as in the model's own library. Repeated rows are treated alike. An empty table gives
no rows. Only the key and the text are read, whatever the names of other columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import chunks, trimmed

SPACE = "▁"
#: Bytes of text whose distinct parts are indexed together.
BATCH_BYTES = 2 << 20
#: Parts remembered in a task before the memory starts anew.
REMEMBERED = 400_000
#: Places for pairs of pieces whose answer is remembered; a later pair takes the place of an earlier one.
PAIR_BITS = 21
#: Characters in an index at most, where a single part is not longer: bounds the memory of a worker.
INDEX_CHARS = 200_000


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    bytes_from: int
    digest: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a BPE model with byte fallback, identity normalisation and a dummy prefix."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            raw = f.read()
        m.ParseFromString(raw)
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are read")
        names = [p.piece for p in m.pieces]
        return cls(names, [p.score for p in m.pieces], [p.type == 1 for p in m.pieces], names.index("<0x00>"), hashlib.sha256(raw).hexdigest())


class Encoder:
    """Encodes lists of texts; remembers parts that it has met."""

    #: Stands between parts in the index; no character has it.
    BETWEEN = 0x110000
    NONE, START = -2, -1

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.id = {p: i for i, p in enumerate(v.pieces) if v.normal[i]}
        self.score = {p: v.scores[i] for p, i in self.id.items()}
        names = list(self.id)
        self.longest = max(map(len, names))
        low = np.zeros((len(names), self.longest), ">u4")
        high = np.full((len(names), self.longest), 0xFFFFFFFF, ">u4")
        for k, p in enumerate(names):
            low[k, : len(p)] = high[k, : len(p)] = np.frombuffer(p.encode("utf-32-be", "surrogatepass"), ">u4")
        low, high = (x.view(f"S{4 * self.longest}").ravel() for x in (low, high))
        order = np.argsort(low)
        self.low, self.high, self.ids = low[order], high[order], np.array(list(self.id.values()), np.int32)[order]
        self.len = np.array([len(p) for p in names], np.int32)[order]
        self.text = list(v.pieces)  # of each id; unknown characters are added behind
        self.unknown: dict[str, int] = {}
        inner = {c for p in names if len(p) > 1 for c in p}
        cut = "".join(re.escape(c) for c in "\n\r\t" if c not in inner)
        crossing = any(SPACE in p.lstrip(SPACE) for p in names)
        self.parts = re.compile("(?s).+" if crossing else (f"[{cut}]|" if cut else "") + f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+").findall
        self.pair, self.stays = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.forget()

    def forget(self) -> None:
        """Lets the parts go; what is known of pairs holds for all texts."""
        self.part: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges by score, leftmost first among equals, leave b behind a; START: b alone."""
        score = self.score.get
        left = "" if a == self.START else self.text[a]
        s = list(left + self.text[b])
        border, never = len(left), float("-inf")  # symbols before the border
        best = [score(x + y, never) for x, y in zip(s, s[1:])]
        while best:
            top = max(best)
            if top == never:
                break
            i = best.index(top)
            if i == border - 1:
                return False
            s[i : i + 2] = [s[i] + s[i + 1]]
            border -= i < border
            del best[i]
            if i < len(best):
                best[i] = score(s[i] + s[i + 1], never)
            if i:
                best[i - 1] = score(s[i - 1] + s[i], never)
        return len(s) == 1 + (a != self.START)

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) + 1 << 32) + b
        place = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, missing = self.stays[place], np.flatnonzero(self.pair[place] != key)
        if len(missing):
            new, at = np.unique(key[missing], return_inverse=True)
            known = np.array([self.may_follow(int(k >> 32) - 1, int(k & 0xFFFFFFFF)) for k in new], bool)
            out[missing] = known[at]
            self.pair[place[missing]], self.stays[place[missing]] = key[missing], out[missing]
        return out

    def suffixes(self, code: np.ndarray) -> np.ndarray:
        """Places in the order of the longest-piece prefixes of their suffixes: packed symbols first, then doubling."""
        n = len(code)
        rank = np.unique(code, return_inverse=True)[1].astype(np.int64) + 1
        bits = int(rank.max()).bit_length()
        depth = max(1, min(self.longest, 62 // bits))
        key = np.zeros(n, np.int64)
        for k in range(depth):
            key <<= bits
            key[: max(n - k, 0)] |= rank[k:]
        while True:
            order = np.argsort(key)
            if depth >= self.longest:
                return order
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], s[1:] != s[:-1]]))
            key = rank * (n + 2)
            key[: max(n - depth, 0)] += rank[depth:]
            depth *= 2

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every occurrence of a piece, and of characters that are none."""
        n = len(code)
        suffix = self.suffixes(code)
        padded = np.zeros(n + self.longest, ">u4")
        padded[:n] = code
        keys = np.lib.stride_tricks.sliding_window_view(padded, self.longest)[suffix].view(f"S{4 * self.longest}").ravel()
        first = np.searchsorted(keys, self.low)
        count = np.searchsorted(keys, self.high, "right") - first
        found = np.flatnonzero(count > 0)
        count, first = count[found], first[found]
        at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        start, length, ids = suffix[at], np.repeat(self.len[found], count), np.repeat(self.ids[found], count)
        alone = code != self.BETWEEN
        alone[start[length == 1]] = False
        lone = np.flatnonzero(alone)
        new = np.array([self.unknown_id(chr(c)) for c in code[lone].tolist()], np.int32)
        return np.concatenate([start, lone]), np.concatenate([length, np.ones(len(lone), np.int32)]), np.concatenate([ids, new])

    def unknown_id(self, c: str) -> int:
        if c not in self.unknown:
            self.unknown[c] = len(self.text)
            self.text.append(c)
        return self.unknown[c]

    def learn(self, parts: list[str]) -> None:
        """Encodes parts that are new."""
        size = np.array([len(p) for p in parts])
        begin = np.cumsum(size + 1) - size - 1
        n = int(begin[-1] + size[-1])
        code = np.full(n + 1, self.BETWEEN, np.uint32)
        code[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        start, length, ids = self.edges(code[:n])
        end = start + length
        level = end - np.repeat(begin, size + 1)[start]
        order = np.argsort((level << 40) + (end << 8) - length)
        start, end, ids, level = start[order], end[order], ids[order], level[order]
        last = np.full(n + 2, self.NONE, np.int32)
        last[begin] = self.START
        bounds = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1], [True]]))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):  # relaxed level by level, in all parts at once
            e = end[lo:hi]
            begins = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            stop = np.append(begins[1:], hi - lo)
            at = begins
            while len(at):  # the longest edge first; the next one only where it may not be taken
                ok = self.allowed(last[start[lo + at]], ids[lo + at])
                took = lo + at[ok]
                last[end[took]] = ids[took]
                at, stop = at[~ok] + 1, stop[~ok]
                at, stop = at[at < stop], stop[at < stop]
        lengths = np.array([len(t) for t in self.text[len(self.v.pieces) :]], np.int64)
        lengths = np.concatenate([self.piece_lengths(), lengths])
        place, part, steps = begin + size, np.arange(len(parts)), []
        while len(part):
            t = last[place]
            steps.append((part, t))
            place = place - lengths[t]
            more = place > begin[part]
            place, part = place[more], part[more]
        owner, tokens = (np.concatenate([s[k] for s in steps]) for k in (0, 1))
        count = np.bincount(owner, minlength=len(parts))
        back = np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
        flat = np.empty(len(tokens), np.int32)
        flat[np.cumsum(count)[owner] - 1 - back] = tokens
        flat, count = self.with_bytes(flat, count)
        for k, p in enumerate(parts, len(self.part)):
            self.part[p] = k
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, count])

    def piece_lengths(self) -> np.ndarray:
        return np.array([len(p) for p in self.v.pieces], np.int64)

    def with_bytes(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as byte pieces."""
        n = len(self.v.pieces)
        odd = np.flatnonzero(flat >= n)
        if not len(odd):
            return flat, count
        coded = {t: self.text[t].encode("utf-8", "surrogatepass") for t in np.unique(flat[odd]).tolist()}
        size = np.ones(len(flat), np.int64)
        for t, raw in coded.items():
            size[odd[flat[odd] == t]] = len(raw)
        first = np.cumsum(size) - size
        out = np.empty(size.sum(), np.int32)
        out[first] = flat
        for t, raw in coded.items():
            for k, x in enumerate(raw):
                out[first[odd[flat[odd] == t]] + k] = self.v.bytes_from + x
        return out, np.bincount(np.repeat(np.arange(len(count)), count), size, len(count)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin and end."""
        if len(self.part) > REMEMBERED:
            self.forget()
        split = [self.parts(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = [p for parts in split for p in parts]
        which = list(map(self.part.get, words))
        if None in which:
            new = list({p for p, k in zip(words, which, strict=True) if k is None})
            del which
            places = np.cumsum([len(p) + 1 for p in new]) // INDEX_CHARS
            for k in range(int(places[-1]) + 1):
                lo, hi = np.searchsorted(places, [k, k + 1])
                if hi > lo:
                    self.learn(new[lo:hi])
            which = list(map(self.part.get, words))
        which = np.array(which, np.int64)
        size = self.sizes[which]
        stop = np.cumsum(size)
        ids = self.flat[np.arange(size.sum()) + np.repeat((np.cumsum(self.sizes) - self.sizes)[which] - stop + size, size)]
        return ids, np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum([len(p) for p in split])]).astype(np.int64)]


#: The encoder of this worker, by the digest of its model: pairs learned in a task serve the next one.
_WORKER: dict[str, Encoder] = {}


def worker_encoder(v: Vocabulary) -> Encoder:
    if v.digest not in _WORKER:
        _WORKER.clear()
        _WORKER[v.digest] = Encoder(v)
    return _WORKER[v.digest]


def byte_table(v: Vocabulary) -> list[bytes]:
    """Bytes that each id stands for, with a plain space for the escaped one; control pieces stand for none."""
    return [p.replace(SPACE, " ").encode() if v.normal[i] else bytes([i - v.bytes_from]) if v.bytes_from <= i < v.bytes_from + 256 else b"" for i, p in enumerate(v.pieces)]


def decode(ids: list[int], table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def encode_column(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, token_ids, and the SHA-256 of the text decoded from them."""
    vocabulary = Vocabulary.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = worker_encoder(vocabulary), byte_table(vocabulary)
        encoder.forget()
        for batch in batches:
            for part in chunks(batch, text, BATCH_BYTES):
                column = part.column(text)
                ids, off = encoder.encode([t or "" for t in column.to_pylist()])
                decoded = [hashlib.sha256(decode(ids[a:b].tolist(), table).encode()).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
                null = column.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null))
                yield pa.record_batch([part.column(key), pa.array(np.diff(off), pa.int64(), mask=null), lists, pa.array(decoded, pa.string(), mask=null)], [key, "n_tokens", "token_ids", "decoded_sha256"])
        encoder.forget()

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(trimmed(run), f"`{key}` {kind}, n_tokens long, token_ids array<int>, decoded_sha256 string")
