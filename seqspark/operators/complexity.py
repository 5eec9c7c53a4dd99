"""Low-complexity check of nucleotide sequences, vectorised over Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = re.compile("[ACGTacgt]+")
_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def _entropies(codes: np.ndarray, size: int, width: int, starts: np.ndarray) -> np.ndarray:
    """Entropy in bits of the words of a width in each window; windows of no word have the highest."""
    word = sum(codes[i : len(codes) - width + 1 + i] * 4 ** (width - 1 - i) for i in range(width))
    per = size - width + 1
    if per <= 0:
        return np.full(len(starts), 2.0 * width)
    rows = word[starts[:, None] + np.arange(per)]
    cells = rows + np.arange(len(starts))[:, None] * 4**width
    counts = np.bincount(cells.reshape(-1), minlength=len(starts) * 4**width).reshape(len(starts), -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(counts > 0, counts * np.log(counts), 0).sum(1)
    return (np.log(per) - part / per) / np.log(2)


def is_low_complexity(seq: str, window: int, step: int, dinuc: float, trinuc: float, min_segment: int, min_fraction: float, min_bp: int, min_windows: int) -> bool:
    total = failing = bp = 0
    for m in SEGMENT.finditer(seq):
        n = len(m[0])
        if n < min_segment:
            continue
        codes = _CODE[np.frombuffer(m[0].encode(), np.uint8)]
        size = min(window, n)
        starts = np.arange(0, n - size + 1, step) if n > window else np.zeros(1, np.int64)
        if n > window and n - window > starts[-1]:
            starts = np.append(starts, n - window)
        low = (_entropies(codes, size, 2, starts) < dinuc) | (_entropies(codes, size, 3, starts) < trinuc)
        total += len(starts)
        failing += int(low.sum())
        bp += int(low.sum()) * size
    return total >= min_windows and failing / total >= min_fraction and bp >= min_bp


def flag(seq: Column, *limits) -> Column:
    @F.pandas_udf("boolean")
    def low(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else is_low_complexity(x, *limits))

    return low(seq)
