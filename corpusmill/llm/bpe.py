"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-token boundaries are found without a regular expression. Every code point gets a class from a table;
white space and apostrophes are refined by the code points that follow. Each class is a transition function
on eight scanner states. The functions these generate under composition form a small finite monoid, so a whole
batch is scanned by composing one-byte function numbers through a table (an associative blocked scan); the state
before each code point then tells whether a pre-token starts there. The slices go through a bounded cache of pair
merges; the byte end of every token is retained, and decoding places token bytes by those offsets.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.runtime import bounded_batches, free_names

LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE_MID, QUOTE1, QUOTE2, RESET = range(9)
NONE, OPEN, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, SUFFIX1, SUFFIX2 = range(8)
# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SEPARATOR = 0x110000
CACHE_PIECES = 200_000
BATCH_CHARS = 1_000_000
BLOCK = 128


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token starts at this code point."""
    if kind == RESET:
        return NONE, True
    if kind == WHITE_MID:
        return IN_WHITE, state != IN_WHITE
    if kind == SPACE_LAST:
        return OPEN, True
    if kind == WHITE_LAST:
        return NONE, True
    if kind == LETTER:
        if state in (SUFFIX1, SUFFIX2):
            return (NONE if state == SUFFIX1 else SUFFIX1), False
        return IN_LETTER, state not in (OPEN, IN_LETTER)
    if kind == NUMBER:
        return IN_NUMBER, state not in (OPEN, IN_NUMBER)
    if kind == OTHER or state in (OPEN, IN_OTHER):
        return IN_OTHER, state not in (OPEN, IN_OTHER)
    return (SUFFIX1 if kind == QUOTE1 else SUFFIX2), True


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(function of class, composition table, state after function, starts by state and class, size)."""
    base = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *base]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    n, fs = len(known), list(known)
    if n > 256:
        raise AssertionError("scanner functions no longer fit in one byte")
    comp = np.array([known[tuple(g[x] for x in f)] for f in fs for g in fs], dtype=np.uint8)
    starts = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)], dtype=bool)
    return np.array([known[f] for f in base], dtype=np.uint8), comp, np.array(fs, dtype=np.uint8), starts, n


@cache
def _classes() -> np.ndarray:
    """Class of each code point before refinement; white space is WHITE_MID, the separator RESET."""
    out = np.full(SEPARATOR + 1, OTHER, dtype=np.uint8)
    for c in range(SEPARATOR):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = WHITE_MID
    out[SEPARATOR] = RESET
    return out


def _scan(f: np.ndarray) -> np.ndarray:
    """State before each position, starting from NONE, by a blocked associative scan over function numbers."""
    _, comp, after, _, n = _monoid()
    size = len(f)
    if size <= BLOCK:
        state, out = NONE, np.empty(size, dtype=np.uint8)
        for i, x in enumerate(f.tolist()):
            out[i] = state
            state = after[x, state]
        return out
    blocks = -(-size // BLOCK)
    m = np.zeros((blocks, BLOCK), dtype=np.uint8)  # number 0 is the identity
    m.reshape(-1)[:size] = f
    m = np.ascontiguousarray(m.T)
    for j in range(1, BLOCK):
        m[j] = comp[m[j - 1].astype(np.int32) * n + m[j]]
    entry = _scan(m[-1])
    state = np.empty((BLOCK, blocks), dtype=np.uint8)
    state[0] = entry
    state[1:] = after.reshape(-1)[m[:-1].astype(np.int32) * 8 + entry]
    return np.ascontiguousarray(state.T).reshape(-1)[:size]


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, for code points in which SEPARATOR divides texts."""
    cls = _classes()[codes]
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=bool)
    white = cls == WHITE_MID
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = ~white[1:] & (cls[1:] != RESET)
    last = white & follows
    cls[last] = np.where(codes[last] == 0x20, SPACE_LAST, WHITE_LAST)
    quote = np.flatnonzero(codes[:-1] == 0x27)
    if len(quote):
        one = codes[quote + 1]
        two = codes[np.minimum(quote + 2, n - 1)]
        cls[quote[np.isin(one, [ord(c) for c in "sdmt"])]] = QUOTE1
        pair = ((one == ord("l")) & (two == ord("l"))) | (((one == ord("v")) | (one == ord("r"))) & (two == ord("e")))
        cls[quote[pair & (quote + 2 < n)]] = QUOTE2
    of_class, _, _, starts, _ = _monoid()
    return starts[_scan(of_class[cls]), cls]


def pretokenize(texts: list[str]) -> Iterator[list[str]]:
    """The pre-tokens of each text, in order, batched by code points rather than rows."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) < BATCH_CHARS):
            chars += len(texts[end]) + 1
            end += 1
        codes = np.empty(chars, dtype=np.uint32)
        pos, spans = 0, []
        for t in texts[at:end]:
            codes[pos : pos + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            codes[pos + len(t)] = SEPARATOR
            spans.append(pos)
            pos += len(t) + 1
        where = np.flatnonzero(piece_starts(codes))
        first = np.searchsorted(where, spans)
        for k, t in enumerate(texts[at:end]):
            stop = np.searchsorted(where, spans[k] + len(t))
            cuts = (where[first[k] : stop] - spans[k]).tolist()
            cuts.append(len(t))
            yield [t[a:b] for a, b in zip(cuts, cuts[1:])] if t else []
        at = end


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in id order from a rank file (base64 token, rank per line)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Codec(dict):
    """Cache from pre-token to its packed ids, in two generations; a missing pre-token is merged pair by pair."""

    def __init__(self, tokens: list[bytes]):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.pair = {
            a << 32 | b: i
            for t, i in self.rank.items()
            for k in range(1, len(t))
            if (a := self.rank.get(t[:k])) is not None and (b := self.rank.get(t[k:])) is not None
        }
        self.byte = [self.rank[bytes([i])] for i in range(256)]
        self.none = len(tokens) + 1
        self.lengths = np.array([len(t) for t in tokens], dtype=np.uint32)
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.first = np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            raw = piece.encode("utf-8", "surrogatepass")
            ids = self._merge_short(raw) if len(raw) <= 64 else self._merge_long(raw)
            packed = array("I", ids).tobytes()
        if len(packed) <= 4096:
            self[piece] = packed
        return packed

    def trim(self) -> None:
        if len(self) > CACHE_PIECES:
            self.old = dict(self)
            self.clear()

    def _merge_short(self, raw: bytes) -> list[int]:
        get, byte, none = self.pair.get, self.byte, self.none
        parts = [byte[b] for b in raw]
        ranks = [get(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        ranks.append(none)
        while (best := min(ranks)) != none:
            i = ranks.index(best)
            parts[i] = best
            del parts[i + 1], ranks[i]
            if i + 1 < len(parts):
                ranks[i] = get(best << 32 | parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | best, none)
        return parts

    def _merge_long(self, raw: bytes) -> list[int]:
        """Heap over adjacent pairs in a linked list: n log n for runs of any length."""
        get, n = self.pair.get, len(raw)
        parts = [self.byte[b] for b in raw]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = rank, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := get(rank << 32 | parts[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, parts[nxt[i]]))
            if (p := prv[i]) >= 0 and (r := get(parts[p] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, p, parts[p], rank))
        return [x for x in parts if x >= 0]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        for pieces in pretokenize(texts):
            self.trim()
            ids = b"".join(map(self.__getitem__, pieces))
            ends = np.cumsum(self.lengths[np.frombuffer(ids, dtype="<u4")], dtype=np.uint32)
            yield ids, ends.astype("<u4").tobytes()

    def decode(self, ids: bytes, ends: bytes) -> bytes:
        """Token bytes placed at their retained offsets."""
        ids_, ends_ = np.frombuffer(ids, dtype="<u4"), np.frombuffer(ends, dtype="<u4").astype(np.int64)
        if not len(ids_):
            return b""
        lengths = self.lengths[ids_]
        shift = np.repeat(self.first[ids_] - ends_ + lengths, lengths)
        shift += np.arange(int(ends_[-1]))
        return self.bytes[shift].tobytes()


_CODECS: dict[int, Codec] = {}


def _codec(tokens: Broadcast) -> Codec:
    """One codec per worker process and vocabulary."""
    key = tokens._jbroadcast.id() if getattr(tokens, "_jbroadcast", None) is not None else id(tokens.value)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokens.value)
    return _CODECS[key]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """Read the rank file once on the driver and broadcast it; its size is that of one vocabulary."""
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(text: Column | str, tokens: Broadcast) -> Column:
    """struct<ids: binary, ends: binary>: ids and byte ends of the tokens as little-endian unsigned 32-bit integers.

    A null text is encoded as the empty text, whose ids are empty.
    """

    @F.pandas_udf("ids binary, ends binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(tokens)
        for s in batches:
            yield pd.DataFrame(list(codec.encode(s.fillna("").tolist())), columns=["ids", "ends"])

    return run(text)


def decode(ids: Column | str, ends: Column | str, tokens: Broadcast) -> Column:
    """The bytes that packed ids stand for; null ids give no bytes."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        codec = _codec(tokens)
        for a, b in batches:
            yield pd.Series([codec.decode(x or b"", y or b"") for x, y in zip(a, b)], dtype=object)

    return run(ids, ends)


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add bpe_ids, bpe_ends (packed token ids and byte ends) and bpe_decoded (the bytes they decode to).

    Rows, nulls and repeated rows are kept as they are; columns of these names are replaced, all others stay; very long texts
    are encoded whole; no rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tokens = vocabulary(spark, path)
    (name,) = free_names(docs, "bpe_")
    coded = docs.withColumn(name, encode(F.col(text), tokens))
    ids, ends = F.col(name).getField("ids"), F.col(name).getField("ends")
    return coded.withColumn("bpe_ids", ids).withColumn("bpe_ends", ends).withColumn("bpe_decoded", decode(ids, ends, tokens)).drop(name)


if sys.byteorder != "little":  # packed ids are read in place
    raise ImportError("a little-endian machine is needed")
