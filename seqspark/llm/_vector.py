"""Words of many texts at once, as arrays over their bytes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are taken at once, unless one text is longer: this bounds a worker's memory.
CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def chunks(texts, limit: int = CHUNK, with_rows: bool = False) -> Iterator:
    """The texts of an Arrow column without nulls, in UTF-8, some at a time; with_rows: with the place of the first."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    raw = texts.cast("binary")
    first = 0
    while first < len(raw):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit)))
        some = raw.slice(first, last - first).to_pylist()
        yield (first, some) if with_rows else some
        first = last
    pa.default_memory_pool().release_unused()


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, BASE_INVERSE):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of texts laid end to end with line feeds between: begin, end (bytes), text number and hash."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        self.raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        n = len(self.raw)
        blank = SPACE[self.raw]
        word = ~blank
        edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_end = np.cumsum(lengths)
        self.doc = np.searchsorted(self.text_end, self.begin, side="right")
        power, inverse = _powers(1 << max(18, int(n).bit_length()))
        chars = LOWER[self.raw] if lower else self.raw
        sums = np.concatenate(([np.uint64(0)], np.cumsum(CODES[chars] * power[:n], dtype=np.uint64)))
        self.hash = mixed((sums[self.end] - sums[self.begin]) * inverse[self.begin] + (self.end - self.begin).astype(np.uint64))
