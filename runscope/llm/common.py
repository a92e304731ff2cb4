"""Words of many texts at once, on the bytes of Arrow columns.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and
carriage return. All of those are single bytes in UTF-8, so words are found without decoding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at a time; one longer text is a piece of its own.
PIECE_BYTES = 4 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column without nulls (they become empty) and with 64-bit offsets."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of the column ``name``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin, base = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin, base = end, int(size[end - 1])


def per_piece(
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], name: str = "text", limit: int = PIECE_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that applies ``fn`` to pieces of bounded size."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, name, limit):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out

    return apply


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string array without nulls, and where each text begins and ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return whole[first : offsets[-1]] if len(offsets) else whole[:0], offsets - first


@dataclass
class Words:
    """All words of a column of texts, in order."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    begin: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # text i has the words first[i] up to first[i + 1]

    @cached_property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def text(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.per_text), dtype=np.int64), self.per_text)

    @cached_property
    def dictionary(self) -> pa.DictionaryArray:
        """Words as numbers that are equal only for equal words."""
        inside = self.data[~_SEPARATOR[self.data]]
        ends = np.zeros(len(self.begin) + 1, np.int64)
        np.cumsum(self.end - self.begin, out=ends[1:])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(inside))]
        )
        return words.dictionary_encode()

    @cached_property
    def code(self) -> np.ndarray:
        return self.dictionary.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def hashes(self, hash_one: Callable[[bytes], int]) -> np.ndarray:
        """``hash_one`` (64 bits) of each word, worked out once per distinct word."""
        known = self.dictionary.dictionary.to_pylist()
        return np.fromiter(map(hash_one, known), np.uint64, len(known))[self.code]

    def normal(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each word begins and ends in that."""
        size = self.end - self.begin
        stop = np.cumsum(size + 1)
        out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
        keep = np.ones(len(out), bool)
        keep[stop - 1] = False
        out[keep] = self.data[~_SEPARATOR[self.data]]
        return out.tobytes(), stop - 1 - size, stop - 1


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of a large_string array without nulls; ``lower`` maps A-Z to a-z first."""
    data, offsets = column_bytes(texts)
    if lower:
        data = data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)
    n = len(data)
    inside = ~_SEPARATOR[data]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    cut[n] = True
    before = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
    begin = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return Words(data, offsets, begin, end, np.searchsorted(begin, offsets))


def spread(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any of the ranges ``start`` up to ``stop``."""
    change = np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def per_text_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that begin at ``first``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64, fixed constants)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hash(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """One number for each run of ``width`` hashes; ordered, so a run and its reverse differ."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15 + 2 * salt), np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return mixed(out)
