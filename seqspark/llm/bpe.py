"""Byte-level BPE encoding and decoding by a public rank file.

Texts of a batch are laid end to end as one code-point array. Each code point gets a class (letter,
number, white space, ...; the look-ahead of the pattern is folded into the class), each class is a
transition function over eight scanner states, and the state before every code point comes from an
associative scan: functions are composed within blocks, the blocks' functions by a doubling scan, and
the blocks are then run side by side from their known entry states. No regular expression is used.
The slices between boundaries go through a bounded cache of pair merging; byte offsets of the tokens
are kept and let any range of ids be decoded.

Defined cases: a null text counts as empty; an empty text has no ids; one of any length is cut into
blocks and never into prefixes; rows are independent, so ties, repeated rows and repeated or null
doc_ids are kept as they are; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_of

L, N, O, Q1, Q2, WI, SP, WL, SEP = range(9)
START, LET, NUM, OTH, WHITE, SPACE, REST1, REST2 = range(8)
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16, by which the library splits, where Python's tables are of an earlier version.
NEWER = {
    L: [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    N: [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
#: Code points that are scanned at once, and pieces that a cache holds: they bound a worker's memory.
CHUNK, CACHED = 1 << 20, 200_000
BLOCK = 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and starts[class, state]: whether a code point of the class begins a piece."""
    nxt = np.zeros((9, 8), np.uint8)
    start = np.ones((9, 8), bool)
    for s in range(8):
        nxt[L, s], nxt[N, s], nxt[O, s], nxt[WI, s], nxt[SP, s], nxt[WL, s], nxt[SEP, s] = LET, NUM, OTH, WHITE, SPACE, START, START
        joins = s in (OTH, SPACE)
        nxt[Q1, s], nxt[Q2, s] = (OTH, OTH) if joins else (REST1, REST2)
        start[L, s] = s not in (LET, SPACE)
        start[N, s] = s not in (NUM, SPACE)
        start[O, s] = start[Q1, s] = start[Q2, s] = not joins
        start[WI, s] = s != WHITE
    for c in range(8):  # the letters after an apostrophe belong to it, whatever they are
        nxt[c, REST1], nxt[c, REST2] = START, REST1
        start[c, REST1] = start[c, REST2] = False
    return nxt, start


NEXT, STARTS = _tables()


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, O, np.uint8)
    for i in range(0x110000):
        k = unicodedata.category(chr(i))[0]
        if k == "L":
            table[i] = L
        elif k == "N":
            table[i] = N
    for k, spans in NEWER.items():
        for a, b in spans:
            table[a : b + 1] = k
    table[WHITE_SPACE] = WL
    return table


def classify(cp: np.ndarray, seps: np.ndarray) -> np.ndarray:
    """The class of each code point; seps are the places between texts."""
    cls = _classes()[cp]
    cls[seps] = SEP
    after = np.append(cls[1:], SEP)
    white = cls == WL
    cls[white & ((after == WL) | (after == SEP))] = WI
    cls[white & (cls == WL) & (cp == 0x20)] = SP
    if len(at := np.flatnonzero(cp == 0x27)):
        pad = np.append(cp, [0, 0])
        a, b = pad[at + 1], pad[at + 2]
        cls[at[(a == 115) | (a == 116) | (a == 109) | (a == 100)]] = Q1
        cls[at[((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))]] = Q2
    return cls


def scan(cls: np.ndarray) -> np.ndarray:
    """The state before each code point, by an associative scan over transition functions."""
    n = len(cls)
    rows = -(-n // BLOCK) or 1
    grid = np.full(rows * BLOCK, SEP, np.uint8)
    grid[:n] = cls
    cols = np.ascontiguousarray(grid.reshape(rows, BLOCK).T).astype(np.intp) * 8
    flat = NEXT.reshape(-1)
    f = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
    for c in cols:  # compose within the blocks, all blocks at once
        f = flat[c[:, None] + f]
    step = 1
    while step < rows:  # inclusive doubling scan over the blocks' functions
        f = np.concatenate([f[:step], np.take_along_axis(f[step:], f[:-step].astype(np.intp), 1)])
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = f[:-1, START]
    out = np.empty((BLOCK, rows), np.uint8)
    for i, c in enumerate(cols):
        out[i] = state
        state = flat[c + state]
    return out.T.reshape(-1)[:n]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, starts and ends of their pieces in it, and the number of pieces of each text."""
    joined = "\n".join(texts) + "\n"
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    seps = np.cumsum(lengths + 1) - 1
    cls = classify(np.frombuffer(joined.encode("utf-32-le"), "<u4"), seps)
    at = np.flatnonzero(STARTS[cls, scan(cls)])  # separators start pieces too
    ends = np.append(at[1:], len(cls))
    real = cls[at] != SEP
    upto = np.searchsorted(at[real], seps)
    return joined, at[real], ends[real], np.diff(upto, prepend=0)


class Ranks:
    """Merging by ranks, with the ids of recent pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes_of[v] = k
        self.length_of = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        ranks = self

        class Cache(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= CACHED:
                    self.clear()
                out = np.array(ranks.merge(piece.encode()), "<u4").tobytes()
                if len(piece) <= 64:
                    self[piece] = out
                return out

        self.cache = Cache()

    def merge(self, piece: bytes) -> list[int]:
        """Always joins the pair of lowest rank, the leftmost of equals, by a heap over linked parts."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # a part begins at its key and ends here; 0: it is gone
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, which are scanned about CHUNK code points at a time."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= CHUNK:
                yield from self._encode(held)
                held, size = [], 0
        if held:
            yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        joined, starts, ends, counts = boundaries(texts)
        at = 0
        get = self.cache.__getitem__
        for n in counts.tolist():
            pieces = [joined[a:b] for a, b in zip(starts[at : at + n].tolist(), ends[at : at + n].tolist(), strict=True)]
            yield np.frombuffer(b"".join(map(get, pieces)), "<u4")
            at += n

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id begins in the text's UTF-8."""
        return np.cumsum(self.length_of[ids]) - self.length_of[ids]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """docs with ids array<int> and byte offsets array<int> of every text's tokens; a null text gives empty arrays."""
    import pyarrow as pa

    if {"ids", "offsets"} & set(docs.columns):
        docs = docs.drop("ids", "offsets")

    def run(batches):
        r = ranks(ranks_path)
        for b in batches:
            ids = list(r.encode([t or "" for t in b.column(text).to_pylist()]))
            both = (ids, [r.offsets(x) for x in ids])
            cols = [pa.array([x.astype(np.int32) for x in xs], pa.list_(pa.int32())) for xs in both]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "ids", "offsets"])

    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{inner}, ids array<int>, offsets array<int>")


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for; null ids give null."""
    @F.pandas_udf("binary")
    def back(xs: pd.Series) -> pd.Series:
        r = ranks(ranks_path)
        return xs.map(lambda x: None if x is None else r.decode(x.tolist()))

    return df.withColumn(out, back(F.col(ids)))


def round_trip_digests(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids, in one pass that ships digests in place of ids.

    Returns key, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.
    """
    import pyarrow as pa

    def run(batches):
        r = ranks(ranks_path)
        names = r.text_of.__getitem__
        for b in batches:
            n, a, c = [], [], []
            for ids in r.encode([t or "" for t in b.column(1).to_pylist()]):
                ids = ids.tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                c.append(hashlib.sha256(r.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_of(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
