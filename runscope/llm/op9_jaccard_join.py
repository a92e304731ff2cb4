"""Near-duplicate documents by an exact set similarity join with rare-first prefix filtering.

A document is the set of its distinct shingles of ``width`` words, 3 by default (A-Z lower-cased), as 64-bit hashes. Equal
sets become one class, which its smallest document stands for. Shingles are ordered by how
common they are in all documents, rare first, ties by hash. Two sets that overlap enough share one of
their first ``n - ceil(t n) + 1`` shingles, so classes are joined on those. A pair that meets at a
shingle must pass

* the length filter: the smaller set has at least ``t`` of the larger one's size,
* the positional filter: what comes before and after the shingle leaves room for the overlap,
* the suffix filter: what comes after it, counted in ``BINS`` hash ranges, differs by no more than allowed;
  and so do the whole sets, counted modulo 2 in ``BITS`` ranges,

is then compared by a sketch that grows with the set, counted modulo 2 as before, and if that leaves it possible
verified once on the whole sets. Commonness is counted in a table of fixed size, over all
documents; it decides the order only, so the join is exact whatever its errors.

What is asked for are components, not pairs, so a shingle that thousands share is not expanded
into all pairs: in each round a class is verified with the most similar one of a few near it, and
classes found to be connected are no longer compared. After ``ROUNDS`` such rounds every pair of
unconnected classes that passes the filters is verified, so no link is lost.

Null and empty texts and texts without words have the empty set, which links with nothing; with fewer words than ``width``, the
whole sequence is the one shingle. Rows without an id are linked with nothing and have a null
component. Rows of one id are one document, linked if one of its texts is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from runscope.llm.common import column_bytes, pieces, text_column, window_hash, words_of
from runscope.llm.components import components
from runscope.llm.tables import measured, without, written

#: Similarity in percent, and words of a shingle, of the op9 query.
PERCENT, WIDTH = 90, 3
#: Counters of how common shingles are, and counters per row sent, as powers of two.
SKETCH_BITS, SEGMENT_BITS = 20, 14
#: Hash ranges of the suffix filter, and those of whole sets.
BINS, BITS = 16, 512
#: Postings of a shingle up to which all of its pairs are looked at, to drop postings without any.
PARTNERS = 256
#: Postings of a shingle up to which a round looks at all of its pairs, too, and pairs that are looked at at a time.
FEW, PAIRS = 12, 200_000
#: Bytes of text that a task works on at a time.
PIECE_BYTES = 2 << 20
#: Rounds that verify one pair per class. Postings of a shingle that are compared with one hub.
ROUNDS, BLOCK = 2, 4096
#: Postings before a posting that it may be verified with in such a round.
BACK = 4


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of all distinct shingles, ordered by text and hash."""
    words = words_of(texts, lower=True)
    hashes = words.hashes(xxhash.xxh3_64_intdigest)
    index = np.arange(len(hashes))
    starts = index[index + width <= words.first[1:][words.text]]
    text, value = [words.text[starts]], [window_hash(hashes, width, width)[starts]]
    for short in range(1, width):  # the whole sequence of a text with fewer words
        those = np.flatnonzero(words.per_text == short)
        text.append(those)
        value.append(window_hash(hashes, short, short)[words.first[those]])
    text, value = np.concatenate(text), np.concatenate(value)
    order = np.argsort(value)
    # numbers of up to 16 bits are sorted in linear time
    order = order[np.argsort(text[order].astype(np.uint16 if len(texts) <= 1 << 16 else np.int64), kind="stable")]
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def _sketch_place(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _rows_of(table: np.ndarray) -> pa.Array:
    """Each row of a table of bytes as one binary value."""
    n, width = table.shape
    ends = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(table.tobytes())])


def _table_of(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of a table of bytes."""
    column = column.cast(pa.large_binary())
    data, ends = column_bytes(column)
    return data.reshape(len(column), int(ends[1]))


def _sketches(text: np.ndarray, value: np.ndarray, n: int) -> list[bytes | None]:
    """For each set its shingles counted modulo 2 in as many hash ranges as it has shingles, or up to twice as many."""
    size = np.bincount(text, minlength=n)
    ranges = 1 << np.ceil(np.log2(np.maximum(size, BITS))).astype(np.int64)
    begin = np.cumsum(ranges) - ranges
    place = begin[text] + ((value >> np.uint64(4)).astype(np.int64) & (ranges[text] - 1))
    odd = np.packbits((np.bincount(place, minlength=int(ranges.sum())) & 1).astype(bool)).tobytes()
    return [odd[b >> 3 : (b + r) >> 3] if k else None for b, r, k in zip(begin.tolist(), ranges.tolist(), size.tolist(), strict=True)]


def sketch_distance(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of two sets only; the finer sketch is folded to the other's ranges."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    folded = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ folded).sum())


def _profiles(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _profile_rows(batches, width)


def _profile_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row per document (size and digest of its set); then the task's counts of shingles, by segment."""
    names = ["doc_id", "n_shingles", "digest", "bitmap", "sketch", "segment", "counts"]
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for piece in pieces(batches, limit=PIECE_BYTES):
        text, value = shingle_sets(text_column(piece), width)
        counts += np.bincount(_sketch_place(value), minlength=len(counts))
        cuts = np.searchsorted(text, np.arange(piece.num_rows + 1))
        data, at = value.tobytes(), (cuts * 8).tolist()
        digests = [xxhash.xxh3_128_digest(data[a:b]) if b > a else None for a, b in zip(at, at[1:], strict=False)]
        place = ((value >> np.uint64(4)) % np.uint64(BITS)).astype(np.int64)
        odd = (np.bincount(text * BITS + place, minlength=piece.num_rows * BITS) & 1).astype(bool)
        nulls = pa.nulls(piece.num_rows)
        yield pa.record_batch(
            [
                piece.column("doc_id"), pa.array(np.diff(cuts)), pa.array(digests, pa.binary()),
                _rows_of(np.packbits(odd.reshape(-1, BITS), axis=1)), pa.array(_sketches(text, value, piece.num_rows), pa.binary()),
                nulls.cast(pa.int32()), nulls.cast(pa.binary()),
            ],
            names,
        )
    press = zstandard.ZstdCompressor(level=1)
    parts = counts.reshape(-1, 1 << SEGMENT_BITS)
    used = np.flatnonzero(parts.any(axis=1))
    if len(used):
        nulls = pa.nulls(len(used))
        yield pa.record_batch(
            [
                nulls.cast(pa.int64()), nulls.cast(pa.int64()), nulls.cast(pa.binary()), nulls.cast(pa.binary()), nulls.cast(pa.binary()),
                pa.array(used.astype(np.int32)),
                pa.array([press.compress(parts[s].tobytes()) for s in used], pa.binary()),
            ],
            names,
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each segment, added up as they arrive."""
    total: dict[int, np.ndarray] = {}
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values = np.frombuffer(unpress.decompress(counts), np.int64)
            total[segment] = total[segment] + values if segment in total else values
    if total:
        yield pa.record_batch(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["segment", "counts"]
        )


def _commonness(profiles: DataFrame) -> np.ndarray:
    """How many documents have a shingle with each hash prefix: a table of fixed size."""
    rows = profiles.where("segment is not null").select("segment", "counts").repartition("segment")
    rows = rows.mapInArrow(_added, "segment int, counts binary")
    counts = np.zeros((1 << (SKETCH_BITS - SEGMENT_BITS), 1 << SEGMENT_BITS), np.int64)
    for segment, data in rows.toLocalIterator():
        counts[segment] = np.frombuffer(data, np.int64)
    # 32 bits are enough for an order
    shift = max(0, int(counts.max()).bit_length() - 32)
    return (counts >> shift).reshape(-1).astype(np.uint32)


def _least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap of sets of these sizes with the similarity: ceil(p (n + m) / (100 + p))."""
    return -((-percent * (n + m)) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -((-percent * n) // 100) + 1


def _postings(counts, percent: int, width: int):
    """Documents → a row per shingle of the prefix, with what the filters need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = counts.value
        for piece in pieces(batches, limit=PIECE_BYTES):
            text, value = shingle_sets(text_column(piece), width)
            if not len(text):
                continue
            # by text and commonness; ties stay by value
            value = value[np.argsort(text.astype(np.uint64) << np.uint64(32) | common[_sketch_place(value)], kind="stable")]
            size = np.bincount(text, minlength=piece.num_rows)
            start = np.cumsum(size) - size
            place = np.arange(len(text)) - start[text]
            chosen = np.flatnonzero(place < prefix_length(size, percent)[text])
            bins = (value & np.uint64(BINS - 1)).astype(np.int64)
            rest = np.bincount(text * BINS + bins, minlength=piece.num_rows * BINS).reshape(-1, BINS)[text[chosen]]
            # take away what the prefix has up to and with each shingle
            seen = np.zeros((len(chosen) + 1, BINS), np.int32)
            seen[np.arange(1, len(chosen) + 1), bins[chosen]] = 1
            np.cumsum(seen, axis=0, out=seen)
            first = np.searchsorted(text[chosen], text[chosen])
            rest = np.minimum(rest - (seen[1:] - seen[first]), 255).astype(np.uint8)
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.record_batch(
                [
                    pa.array(value[chosen].view(np.int64)), pa.array(ids[text[chosen]]), pa.array(size[text[chosen]].astype(np.int32)),
                    pa.array(place[chosen].astype(np.int32)), _rows_of(rest),
                ],
                POSTING,
            )

    return run


POSTING = ["token", "node", "n", "place", "rest"]
_POSTING_SQL = "token long, node long, n int, place int, rest binary"


def prefix_filters(
    n: np.ndarray, place: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether pairs of postings pass the three filters, how many shingles differ at least, and may at most."""
    size, other, i, j = n[a], n[b], place[a], place[b]
    need = _least_overlap(size, other, percent)
    length = np.minimum(size, other) * 100 >= percent * np.maximum(size, other)
    position = np.minimum(i, j) + np.minimum(size - i, other - j) >= need
    allowed = size + other - 2 * need
    apart = np.abs(i - j)
    left = np.flatnonzero(length & position & (apart <= allowed))
    x, y = rest[a[left]], rest[b[left]]
    apart[left] += (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
    fits = np.zeros(len(a), bool)
    fits[left] = apart[left] <= allowed[left]
    return fits, apart, allowed


class Postings:
    """Postings of one shingle, by size, or of several: what the filters say about pairs of them."""

    def __init__(self, columns: list[np.ndarray], percent: int) -> None:
        self.node, self.n, self.place, self.rest, bitmap, self.label = columns
        self.bitmap = np.ascontiguousarray(bitmap).view(np.uint64)
        self.percent = percent

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At least so many shingles differ, or -1 if the pair can't be similar enough or is known to be connected."""
        out = np.full(len(a), -1)
        new = np.flatnonzero(self.label[a] != self.label[b])
        a, b = a[new], b[new]
        fits, apart, allowed = prefix_filters(self.n, self.place, self.rest, a, b, self.percent)
        left = np.flatnonzero(fits)
        whole = np.bitwise_count(self.bitmap[a[left]] ^ self.bitmap[b[left]]).sum(axis=1, dtype=np.int64)
        out[new[left]] = np.where(whole <= allowed[left], np.maximum(whole, apart[left]), -1)
        return out

    def nearest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Some pairs, a few per posting: with those just before, and with the most central of the block."""
        n = len(self.node)
        pairs = [(np.arange(n - back), np.arange(back, n)) for back in range(1, min(BACK, n - 1) + 1)]
        hub_before = None
        for begin in range(0, n, BLOCK):
            block = np.arange(begin, min(n, begin + BLOCK))
            rest = self.rest[block].astype(np.float32)
            hub = begin + int(np.abs(rest - np.median(rest, axis=0)).sum(axis=1).argmin())
            pairs.append((np.full(len(block), hub), block))
            if hub_before is not None:
                pairs.append((np.full(len(block), hub_before), block))
            hub_before = hub
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        d = self.distance(a, b)
        return a[d >= 0], b[d >= 0], d[d >= 0]

    def every(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs that pass the filters, a posting at a time with those not much larger."""
        reach = np.searchsorted(self.n, (100 * self.n) // self.percent, "right")
        for i in range(len(self.node)):
            others = np.arange(i + 1, reach[i])
            if len(others):
                mine = np.full(len(others), i)
                d = self.distance(mine, others)
                if (d >= 0).any():
                    yield mine[d >= 0], others[d >= 0], d[d >= 0]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Rows of tokens that several rows have, as arrays, and where each token's begin; rows come ordered by token."""
    held: list[np.ndarray] | None = None

    def several(columns: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        token = columns[0]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(begin, len(token)))
        shared = size > 1
        if shared.any():
            size, keep = size[shared], np.repeat(shared, size)
            yield [c[keep] for c in columns], np.append(0, np.cumsum(size))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_table_of(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last:
            yield from several([c[:last] for c in columns])
        held = [c[last:] for c in columns]
    if held is not None:
        yield from several(held)


def _pairs_within(edges: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the groups that have up to ``most`` rows, many groups and up to about ``PAIRS`` pairs at a time."""
    size = np.diff(edges)
    row = np.arange(edges[0], edges[-1])
    others = np.repeat(np.where(size <= most, edges[1:], 0), size) - row - 1  # rows of the group behind each
    row, others = row[others > 0], others[others > 0]
    total = np.cumsum(others)
    begin = 0
    while begin < len(row):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] - others[begin] + PAIRS, "right")))
        a = np.repeat(row[begin:end], others[begin:end])
        nth = np.arange(len(a)) - np.repeat(np.cumsum(others[begin:end]) - others[begin:end], others[begin:end])
        yield a, a + 1 + nth
        begin = end


def _partnered(columns: list[np.ndarray], edges: np.ndarray, percent: int) -> list[np.ndarray]:
    """The postings that pass the filters with another of their shingle; all of a shingle with many."""
    _, node, n, place, rest = columns
    n, place, size = n.astype(np.int64), place.astype(np.int64), np.diff(edges)
    keep = np.zeros(len(node), bool)
    for begin, end in zip(edges[:-1][size > PARTNERS].tolist(), edges[1:][size > PARTNERS].tolist(), strict=True):
        keep[begin:end] = (node[begin:end] != node[begin]).any()
    for a, b in _pairs_within(edges, PARTNERS):
        other = np.flatnonzero(node[a] != node[b])
        a, b = a[other], b[other]
        fits, _, _ = prefix_filters(n, place, rest, a, b, percent)
        keep[a[fits]] = keep[b[fits]] = True
    return [c[keep] for c in columns]


def _shared_only(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings that a pair can come from; most shingles that unlike documents share end here."""
    return lambda batches: _shared(batches, percent)


def _shared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for columns, edges in _groups(batches):
        token, node, n, place, rest = _partnered(columns, edges, percent)
        if len(token):
            yield pa.record_batch([pa.array(token), pa.array(node), pa.array(n), pa.array(place), _rows_of(rest)], POSTING)


def _candidates(percent: int, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    # shingles with few postings are looked at many at a time, all pairs of them
    few = PARTNERS if every else FEW

    def found(columns: list[np.ndarray], edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        _, node, n, place, rest, bitmap, label = columns
        columns = [node, n.astype(np.int64), place.astype(np.int64), rest, bitmap, label]
        together = Postings(columns, percent)
        for a, b in _pairs_within(edges, few):
            d = together.distance(a, b)
            yield node[a[d >= 0]], node[b[d >= 0]], d[d >= 0]
        many = np.diff(edges) > few
        for begin, end in zip(edges[:-1][many].tolist(), edges[1:][many].tolist(), strict=True):
            mine = [c[begin:end] for c in columns]
            if (mine[-1] == mine[-1][0]).all():
                continue
            postings = Postings(mine, percent)
            for a, b, d in postings.every() if every else [postings.nearest()]:
                yield mine[0][a], mine[0][b], d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            a, b, d = (np.concatenate(c) for c in zip(*kept, strict=True))
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], ["a", "b", "apart"])

        for columns, edges in _groups(batches):
            for a, b, d in found(columns, edges):
                if len(a):
                    kept.append((a, b, d))
                    size += len(a)
                    if size >= 20_000:
                        yield out()
                        kept, size = [], 0
        if kept:
            yield out()

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _set_rows(batches, width)


def _set_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Whole sets as ordered 64-bit hashes."""
    for piece in pieces(batches, limit=PIECE_BYTES):
        text, value = shingle_sets(text_column(piece), width)
        data, at = value.tobytes(), (np.searchsorted(text, np.arange(piece.num_rows + 1)) * 8).tolist()
        yield pa.record_batch(
            [piece.column("doc_id"), pa.array([data[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["node", "hashes"]
        )


def _verified(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            linked = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([linked.column("a"), linked.column("b")], ["a", "b"])

    return run


def _close(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            allowed = (n + m - 2 * _least_overlap(n, m, percent)).tolist()
            apart = map(sketch_distance, batch.column("x").to_pylist(), batch.column("y").to_pylist())
            near = batch.filter(pa.array([d <= most for d, most in zip(apart, allowed, strict=True)], pa.bool_()))
            yield pa.record_batch([near.column("a"), near.column("b")], ["a", "b"])

    return run


def close_pairs(profiles: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``pairs(a, b)`` without those that sketches, a hundredth of the sets, show to be too far apart."""
    needed = measured(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "sketched")
    known = profiles.where("segment is null and digest is not null").join(needed, "doc_id", "left_semi")
    known = written(known.select("doc_id", F.col("n_shingles").alias("n"), "sketch").distinct(), "sketches")
    x = pairs.select("a", "b").join(known.select(F.col("doc_id").alias("a"), "n", F.col("sketch").alias("x")), "a")
    both = x.join(known.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(_close(percent), "a long, b long").distinct()


def verify(docs: DataFrame, pairs: DataFrame, repeated: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Those of ``pairs(a, b)`` of ids whose whole sets are similar enough; ``repeated(doc_id)``: ids of several rows."""
    needed = measured(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    docs = docs.select("doc_id", "text").join(needed, "doc_id", "left_semi")

    def sets_of(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(_sets(width), "node long, hashes binary")

    # only rows of an id that has several can be the same; the others' sets stay where they are
    several = sets_of(docs.join(repeated, "doc_id", "left_semi")).distinct()
    sets = written(sets_of(docs.join(repeated, "doc_id", "left_anti")).unionByName(several), "sets")
    # the set of one side travels with the pair to where that of the other is
    x = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = x.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node of its component, for all nodes with a link."""
    roots = components(links)
    least = roots.groupBy("root").agg(F.min("node").alias("label"))
    return written(roots.join(least, "root").select("node", "label"), "components")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``docs(doc_id, text)`` → ``(doc_id, n_shingles, component_id)``, a row per row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    profiles = written(
        docs.mapInArrow(_profiles(width), "doc_id long, n_shingles long, digest binary, bitmap binary, sketch binary, segment int, counts binary"), "profiles"
    )
    counts = spark.sparkContext.broadcast(_commonness(profiles))  # 4 MB, whatever the corpus
    rows = profiles.where("segment is null").select("doc_id", "n_shingles", "digest")
    named = rows.where("doc_id is not null and digest is not null")
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")

    postings = (
        docs.join(measured(classes.select(F.col("node").alias("doc_id")).distinct(), "nodes"), "doc_id", "left_semi")
        .mapInArrow(_postings(counts, percent, width), _POSTING_SQL)
        .repartition("token")
        .sortWithinPartitions("token", "n", "node")
        .mapInArrow(_shared_only(percent), _POSTING_SQL)
    )
    # a posting gets the bitmap of each text of its node; with repeated ids, that of its own is among them
    bitmaps = profiles.where("segment is null and doc_id is not null").select(F.col("doc_id").alias("node"), "bitmap").distinct()
    postings = written(written(postings, "shared").join(bitmaps, "node").select(*POSTING, "bitmap"), "postings")
    # texts of one id are one document, which may be the smallest of neither of its classes
    several = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("least"), F.max("digest").alias("most"))
    repeated = measured(several.where("n > 1").select("doc_id", F.expr("least <> most").alias("differ")), "repeated-ids")
    several = repeated.where("differ").select("doc_id")
    repeated = repeated.select("doc_id")
    same = named.join(several, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "node")
    first = same.groupBy("doc_id").agg(F.min("node").alias("a"))
    links = written(same.join(first, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "links")
    labels, tried = None if links.isEmpty() else _labels(links), None
    for number in range(ROUNDS + 1):
        every = number == ROUNDS
        current = postings.withColumn("label", F.col("node"))
        if labels is not None:
            current = postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        found = (
            current.select(*POSTING, "bitmap", "label")
            .repartition("token")
            .sortWithinPartitions("token", "n", "node")
            .mapInArrow(_candidates(percent, every), "a long, b long, apart long")
        )
        if every:
            pairs = found.select("a", "b").distinct()
        else:  # each node with its most similar candidate
            ends = found.select(F.explode(F.array("a", "b")).alias("node"), F.struct("apart", "a", "b").alias("pair"))
            best = ends.groupBy("node").agg(F.min("pair").alias("pair"))
            pairs = best.select("pair.a", "pair.b").distinct()
        if tried is not None:  # no pair is verified twice
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = measured(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        close = measured(close_pairs(profiles, pairs, percent), "close")
        new = written(verify(docs, close, repeated, percent, width), "links")
        links = links.unionByName(new)
        labels = _labels(links)
    # an empty text of an id that has others, too
    bare = measured(rows.where("doc_id is not null and digest is null").select("doc_id").distinct(), "empty-texts")
    other = named.join(bare, "doc_id", "left_semi").join(classes, "digest").groupBy("doc_id").agg(F.min("node").alias("other"))
    out = rows.join(classes.repartition(F.xxhash64("digest")), "digest", "left").join(measured(other, "other-texts"), "doc_id", "left")
    out = out.withColumn("node", F.coalesce("node", "other"))
    if labels is None:
        out = out.withColumn("label", F.lit(None).cast("long"))
    else:
        out = out.join(labels.repartition(F.xxhash64("node")), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def one_per_group(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``docs`` without those that are linked, over any number of links, with a smaller one.

    Of repeated rows with the smallest id all stay.
    """
    found = near_duplicates(docs, percent, width)
    return without(docs, found.where("component_id <> doc_id").select("doc_id"), "near-duplicates")
