"""Hashed byte n-grams of lower-cased texts, for classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from runscope.llm.common import column_bytes

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of lower-cased texts, everything ASCII but letters blank, and where each begins."""
    data, offsets = column_bytes(pa.array([t.lower() for t in texts], pa.large_string()))
    return _BLANK[data], offsets


def has_letter(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


def grams(data: np.ndarray, offsets: np.ndarray, size: int, bits: int, in_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(text, bucket)`` of each run of ``size`` (at most 8) bytes; ``in_word``: only without blanks."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    keep = np.ones(n, bool)
    for k in range(size):
        part = data[k : k + n]
        value = value << np.uint64(8) | part
        if in_word:
            keep &= part != 0x20
    starts = offsets[1:-1]
    for k in range(1, size):  # runs that reach into the next text
        cut = starts - k
        keep[cut[(cut >= 0) & (cut < n)]] = False
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    bucket = ((value + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return text[keep], bucket[keep].astype(np.int64)
