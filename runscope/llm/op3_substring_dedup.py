"""Removal of repeated passages: super-k-mers of words, dealt to buckets by their minimiser.

A window is ``WIDTH`` consecutive words of one text. Its minimiser is the smallest hash of the
``GRAM``-word runs in it, so equal windows have equal minimisers. Consecutive windows with the
same minimiser (a super-k-mer) travel as one packed string, their words with single spaces, to the
minimiser's bucket. There all windows are sorted, compared word by word, and the smallest
document of each is known. What is returned for a document are the word ranges that windows of
smaller documents cover.

Each task packs a piece of text at a time and sends each different string of a piece once, so
copies cost little. For a bucket come first all strings, which are
merged as they arrive, and then all occurrences (string hash, document, place), which are answered as they
arrive; a task holds the different strings of one bucket and never the occurrences.

Words are compared unchanged. Null texts count as empty. A document without an id counts as larger
than any other. Rows are told apart by id and text, so repeated rows get the same result each;
windows of rows with the same id don't remove each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from runscope.llm.common import PIECE_BYTES, Words, mixed, pieces, spread, text_column, window_hash, words_of

#: Words of a window, and of the runs that its minimiser is chosen from.
WIDTH, GRAM = 13, 3
#: Buckets per shuffle partition: a task holds one bucket at a time.
BUCKETS_PER_PARTITION = 4
#: How hard what is shuffled is compressed.
LEVEL = 6
#: The id that a document without one counts as.
NAMELESS = np.iinfo(np.int64).max


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def windows_of(words: Words, width: int = WIDTH) -> np.ndarray:
    """The first words of all windows."""
    index = np.arange(len(words.begin))
    return index[index + width <= words.first[1:][words.text]]


def super_kmers(words: Words, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each super-k-mer, and its minimiser."""
    starts = windows_of(words, width)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    hashes = window_hash(words.hashes(_hash), gram)
    least = hashes[starts].copy()
    for k in range(1, width - gram + 1):
        np.minimum(least, hashes[starts + k], out=least)
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (least[1:] != least[:-1]) | (words.text[starts[1:]] != words.text[starts[:-1]])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(starts)) - 1
    return starts[begin], starts[end], least[begin]


def _pack(values: np.ndarray) -> bytes:
    """Numbers as differences, compressed."""
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.diff(values, prepend=values.dtype.type(0)).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind), dtype=kind)


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.large_binary())


def _senders(n_buckets: int):
    """Pieces of text → rows of strings (phase 0) and of occurrences (phase 1) by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for piece in pieces(batches):
            words = words_of(text_column(piece))
            first, last, least = super_kmers(words)
            if not len(first):
                continue
            doc = piece.column("doc_id").fill_null(NAMELESS).to_numpy(zero_copy_only=False).astype(np.int64)
            tag = piece.column("tag").to_numpy(zero_copy_only=False).astype(np.int32)
            normal, begin, end = words.normal()
            packed = [normal[a:b] for a, b in zip(begin[first].tolist(), end[last + WIDTH - 1].tolist(), strict=True)]
            coded = _binary(packed).dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            strings = coded.dictionary.to_pylist()
            del packed
            text = words.text[first]
            place = (first - words.first[text]).astype(np.int32)
            smallest = np.full(len(strings), NAMELESS)
            np.minimum.at(smallest, which, doc[text])
            bucket_of = np.zeros(len(strings), np.int64)
            bucket_of[which] = (mixed(least) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket_of, kind="stable")  # strings by bucket
            rank = np.empty(len(strings), np.int64)
            rank[order] = np.arange(len(order))
            hashes = np.fromiter(map(_hash, strings), np.uint64, len(strings))
            mine = np.lexsort((place, doc[text], rank[which]))  # occurrences by bucket and string
            edges = np.searchsorted(bucket_of[order], np.arange(n_buckets + 1))
            cuts = np.searchsorted(bucket_of[which[mine]], np.arange(n_buckets + 1))
            rows: list[tuple] = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                those = order[edges[b] : edges[b + 1]]
                rows.append((b, 0, press.compress(b"\n".join([strings[i] for i in those.tolist()])), _pack(smallest[those]), b"", b""))
                own = mine[cuts[b] : cuts[b + 1]]
                rows.append((b, 1, hashes[which[own]].tobytes(), _pack(doc[text[own]]), tag[text[own]].tobytes(), _pack(place[own])))
            for at in range(0, len(rows), 256):
                columns = list(zip(*rows[at : at + 256], strict=True))
                yield pa.record_batch(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])],
                    ["bucket", "phase", "strings", "docs", "tags", "places"],
                )

    return run


class Bucket:
    """The different strings of a bucket, and for each window the smallest document it is in."""

    def __init__(self) -> None:
        self.smallest: dict[bytes, int] = {}

    def add(self, strings: list[bytes], docs: list[int]) -> None:
        known = self.smallest
        for s, d in zip(strings, docs, strict=True):
            before = known.get(s)
            if before is None or d < before:
                known[s] = d

    def finish(self) -> None:
        """Sort all windows; equal ones share the smallest document."""
        strings = list(self.smallest)
        docs = np.fromiter(self.smallest.values(), np.int64, len(strings))
        self.smallest.clear()
        hashes = np.fromiter(map(_hash, strings), np.uint64, len(strings))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two strings of a bucket have the same 64-bit hash")
        self.first = np.zeros(len(strings) + 1, np.int64)  # windows of each string
        words = words_of(pa.array(strings, pa.large_binary()))
        starts = windows_of(words)
        string = words.text[starts]
        self.first[1:] = np.cumsum(np.bincount(string, minlength=len(strings)))
        key = window_hash(mixed(words.code.astype(np.uint64) + np.uint64(1)), WIDTH)[starts]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        a, b = starts[order[1:]][same], starts[order[:-1]][same]
        if any((words.code[a + k] != words.code[b + k]).any() for k in range(WIDTH)):
            # different windows share a hash: number windows by their words themselves
            table = np.lib.stride_tricks.sliding_window_view(words.code, WIDTH)[starts]
            key = np.unique(table, axis=0, return_inverse=True)[1].reshape(-1)
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
        group = np.append(0, np.flatnonzero(~same) + 1) if len(order) else np.zeros(0, np.int64)
        self.least = np.empty(len(starts), np.int64)
        if len(order):
            least = np.minimum.reduceat(docs[string[order]], group)
            self.least[order] = np.repeat(least, np.diff(np.append(group, len(order))))

    def repeated(self, hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(occurrence, begin, end)``: words that windows of smaller documents cover."""
        string = self.order[np.searchsorted(self.hashes, hashes)]
        n = self.first[string + 1] - self.first[string]
        who = np.repeat(np.arange(len(string)), n)
        within = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        hit = self.least[self.first[string][who] + within] < docs[who]
        who, within = who[hit], within[hit]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (within[1:] != within[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(who)) - 1
        who = who[begin]
        return who, places[who] + within[begin], places[who] + within[end[: len(begin)]] + WIDTH


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by bucket and phase → ranges of words to remove."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    unpress = zstandard.ZstdDecompressor()
    for _, group in groupby(rows, key=lambda r: r[0]):
        bucket, open_ = Bucket(), True
        for _, phase, strings, docs, tags, places in group:
            if phase == 0:
                bucket.add(unpress.decompress(strings).split(b"\n"), _unpack(docs, np.int64).tolist())
                continue
            if open_:
                bucket.finish()
                open_ = False
            doc = _unpack(docs, np.int64)
            who, begin, end = bucket.repeated(np.frombuffer(strings, np.uint64), doc, _unpack(places, np.int32))
            if len(who):
                yield pa.record_batch(
                    [pa.array(doc[who]), pa.array(np.frombuffer(tags, np.int32)[who]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))],
                    ["doc", "tag", "begin", "end"],
                )


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a number that tells apart rows of one id with different texts."""
    return docs.select("doc_id", "text", (F.xxhash64("text") % (1 << 31)).cast("int").alias("tag"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → ``(doc, tag, begin, end)``: words that repeat those of smaller documents.

    Ranges of one document may overlap. ``doc`` is :data:`NAMELESS` where the id is null.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = _keyed(docs).mapInArrow(
        _senders(partitions * BUCKETS_PER_PARTITION),
        "bucket int, phase int, strings binary, docs binary, tags binary, places binary",
    )
    dealt = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket", "phase")
    return dealt.mapInArrow(_answer, "doc long, tag int, begin int, end int")


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the shuffle that brings them to their ranges."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    for piece in pieces(batches):
        packed = [press.compress((t or "").encode()) for t in piece.column("text").to_pylist()]
        yield pa.record_batch([piece.column("doc_id"), piece.column("tag"), pa.array(packed, pa.binary())], ["doc_id", "tag", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their texts again, a bounded number of bytes at a time."""
    unpress = zstandard.ZstdDecompressor()
    for piece in pieces(batches, "packed", PIECE_BYTES // 4):
        texts = [unpress.decompress(p) for p in piece.column("packed").to_pylist()]
        yield pa.record_batch(
            [piece.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), piece.column("ranges")], ["doc_id", "text", "ranges"]
        )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(_unpacked(batches)):
        words = words_of(text_column(piece))
        n = len(words.begin)
        ranges = piece.column("ranges")
        row = np.repeat(np.arange(piece.num_rows), ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = ranges.flatten()
        base = words.first[:-1][row]
        removed = spread(base + flat.field("begin").to_numpy(zero_copy_only=False), base + flat.field("end").to_numpy(zero_copy_only=False), n)
        normal, begin, end = words.normal()
        size = end - begin + 1
        kept = np.frombuffer(normal, np.uint8)[np.repeat(~removed, size)].tobytes()
        total = np.zeros(n + 1, np.int64)
        np.cumsum(np.where(removed, 0, size), out=total[1:])
        at = total[words.first].tolist()
        texts = [kept[a : max(a, b - 1)] for a, b in zip(at, at[1:], strict=False)]
        gone = np.zeros(n + 1, np.int64)
        np.cumsum(removed, out=gone[1:])
        yield pa.record_batch(
            [
                piece.column("doc_id"), pa.array(words.per_text.astype(np.int64)), pa.array(np.diff(gone[words.first])),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _apply(batches):
        digests = [hashlib.sha256(t.as_buffer()).hexdigest() for t in batch.column("kept")]
        yield pa.record_batch(
            [*batch.columns[:3], pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
        )


def _with_ranges(docs: DataFrame) -> DataFrame:
    ranges = repeated_ranges(docs).groupBy("doc", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    rows = _keyed(docs).mapInArrow(_packed_texts, "doc_id long, tag int, packed binary")
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(int(NAMELESS))))
    return rows.join(ranges, ["doc", "tag"], "left").select("doc_id", "packed", "ranges")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → ``(doc_id, n_words, n_removed, kept)``, a row per row."""
    return _with_ranges(docs).mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats_digest(docs: DataFrame) -> DataFrame:
    """The same with the SHA-256 of the kept words, without shipping texts out of the task."""
    return _with_ranges(docs).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
