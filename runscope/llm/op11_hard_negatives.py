"""Hard negatives by angles to reference directions.

Scores are integer inner products of ``floor(256 x)``. Each row stores its angles to ``REFERENCES`` directions.
By the triangle inequality on the sphere, two rows whose angles to a direction are ``s`` and ``t`` are at least
``|s - t|`` and at most ``min(s + t, 2 pi - s - t)`` apart; over all directions this is an interval of the
cosine, and times the norms one of the score, widened by more than rounding can amount to. Rows lie in windows
of like angles, and an anchor is scored with a window only if the window's interval can hold what it looks
for: a score as high as its fifth best so far, or one between the limits of a positive.

Rows are range-partitioned into blocks of windows. Anchors are first scored within their own block, which gives
a score that their positives must reach, then sent to the blocks whose intervals reach it, and once more to
the blocks that may hold their negatives. In a block, at most ``VISITORS`` anchors are scored at a time by a
matrix product that is exact.

A label and vector that many rows have is one hot group: no anchor can have more than its ``positives + 1``
smallest ids among its positives, or its ``negatives`` smallest ids among its negatives, so other copies are
anchors only.

Rows take part as ``sound_vectors`` says, and need a label; zero vectors do. A row whose norm times 256 is 2^31
or more takes no part, as its scores may not fit 64 bits. Of rows with the same id the one with the least label
and vector counts. Anchors without another row of their label, and positives without a negative, give no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from runscope.llm.tables import written
from runscope.llm.vectors import matrix, one_per_id, packed, sound_vectors, unpacked

#: Reference directions, and the rows with the smallest hashes that they are chosen from.
REFERENCES, SAMPLE = 8, 2048
#: Rows of a block and of a window, anchors that visit a block at a time, and blocks whose windows are looked at together.
BLOCK, WINDOW, VISITORS, CHUNK = 8192, 256, 4096, 512
#: What a bound on a cosine is widened by; angles and cosines err by less than a thousandth of it.
SLACK = 1e-6

VECTOR = "vec_id long, label int, candidate boolean, ints binary, norm double, angles binary"


def spread_out(vectors: np.ndarray, n: int) -> np.ndarray:
    """Unit directions of up to ``n`` of the vectors, each the farthest from those before."""
    norm = np.linalg.norm(vectors, axis=1)
    units = vectors[norm > 0] / norm[norm > 0, None]
    if not len(units):
        return np.eye(1, vectors.shape[1])
    chosen, nearest = [units[0]], units @ units[0]
    while len(chosen) < min(n, len(units)):
        at = int(nearest.argmin())
        chosen.append(units[at])
        nearest = np.maximum(nearest, units @ units[at])
    return np.array(chosen)


def _angled(directions: np.ndarray) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix(batch.column("ints"))
            norm = np.sqrt((values * values).sum(axis=1))
            cosine = np.clip(values @ directions.T / np.where(norm > 0, norm, 1.0)[:, None], -1.0, 1.0)
            angles = np.arccos(cosine)
            columns = [batch.column(c) for c in ("vec_id", "label", "candidate")]
            yield pa.record_batch(
                [*columns, packed(values.astype(np.int32)), pa.array(norm), packed(angles), pa.array(cosine.argmax(axis=1).astype(np.int32)), pa.array(angles.min(axis=1))],
                ["vec_id", "label", "candidate", "ints", "norm", "angles", "home", "angle"],
            )

    return run


def _window_starts(label: np.ndarray) -> np.ndarray:
    """First rows of windows: of one label each, and of ``WINDOW`` rows at most."""
    n = len(label)
    first = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    run = np.repeat(first, np.diff(np.append(first, n)))
    return np.flatnonzero((np.arange(n) - run) % WINDOW == 0)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the block of each row: the partition and how many full blocks it had before."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        if batch.num_rows:
            at = (seen + np.arange(batch.num_rows)) // BLOCK
            seen += batch.num_rows
            columns = [batch.column(c) for c in ("vec_id", "label", "candidate", "ints", "norm", "angles")]
            yield pa.record_batch([*columns, pa.array((np.int64(part) << 32) + at)], ["vec_id", "label", "candidate", "ints", "norm", "angles", "block"])


class Rows:
    """Rows of a block, or anchors, as arrays."""

    def __init__(self, table: pa.Table) -> None:
        self.id = table.column("vec_id").to_numpy()
        self.label = table.column("label").to_numpy()
        self.ints = unpacked(table.column("ints"), np.int32)
        self.norm = table.column("norm").to_numpy()
        self.angles = unpacked(table.column("angles"), np.float64)

    def take(self, at: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        for name, values in vars(self).items():
            setattr(out, name, values[at])
        return out

    def __len__(self) -> int:
        return len(self.id)


def window_bounds(rows: Rows) -> tuple[np.ndarray, ...]:
    """First row, label, least and greatest angles and norms of the windows of rows ordered by label."""
    starts = _window_starts(rows.label)
    reach = [f.reduceat(x, starts, axis=0) for x in (rows.angles, rows.norm) for f in (np.minimum, np.maximum)]
    return starts, rows.label[starts], *reach


def score_bounds(norm: np.ndarray, angles: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score of each anchor with any row of each window, rounded outwards."""
    near = np.zeros((len(norm), len(low)))
    far = np.full((len(norm), len(low)), np.pi)
    for j in range(angles.shape[1]):
        own = angles[:, j, None]
        near = np.maximum(near, np.maximum(low[None, :, j] - own, own - high[None, :, j]))
        a, b = own + low[None, :, j], own + high[None, :, j]
        turned = np.where((a <= np.pi) & (b >= np.pi), np.pi, np.maximum(np.minimum(a, 2 * np.pi - a), np.minimum(b, 2 * np.pi - b)))
        far = np.minimum(far, turned)
    top, bottom = np.cos(np.minimum(near, np.pi)) + SLACK, np.cos(far) - SLACK
    upper = norm[:, None] * np.where(top >= 0, top * most, top * least) + 1
    lower = norm[:, None] * np.where(bottom >= 0, bottom * least, bottom * most) - 1
    return lower, upper


def scores(anchors: Rows, rows: Rows) -> np.ndarray:
    """Inner products, exactly: by floating point where every partial sum fits its 53 bits."""
    if len(anchors) and len(rows) and anchors.norm.max() * rows.norm.max() < 2.0**52:
        return (anchors.ints.astype(np.float64) @ rows.ints.astype(np.float64).T).astype(np.int64)
    return anchors.ints.astype(np.int64) @ rows.ints.astype(np.int64).T


def _best(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each key: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, key))
    key = key[order]
    rank = np.arange(len(key)) - np.searchsorted(key, key)
    return order[rank < k]


def positives_within(anchors: Rows, need: np.ndarray, rows: Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, row, score)`` of the best rows of each anchor's label; only scores of ``need`` or more count."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    starts, label, low, high, least, most = window_bounds(rows)
    stops = np.append(starts[1:], len(rows))
    for begin in range(0, len(anchors), 1024):
        part = np.arange(begin, min(begin + 1024, len(anchors)))
        some = anchors.take(part)
        _, upper = score_bounds(some.norm, some.angles, low, high, least, most)
        wanted = (some.label[:, None] == label[None, :]) & (upper >= need[part, None])
        for w in np.flatnonzero(wanted.any(axis=0)):
            who = part[wanted[:, w]]
            inside = np.arange(starts[w], stops[w])
            score = scores(anchors.take(who), rows.take(inside))
            a, r = np.nonzero((score >= need[who, None]) & (anchors.id[who, None] != rows.id[None, inside]))
            keep = _best(who[a], score[a, r], rows.id[inside[r]], k)
            found.append((who[a][keep], inside[r][keep], score[a, r][keep]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, r, s = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = _best(a, s, rows.id[r], k)
    return a[keep], r[keep], s[keep]


def limits(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer score of a negative: from 50 to 95 percent of the positive's."""
    return -((-positive) // 2), (95 * (positive // 100)) + (95 * (positive % 100)) // 100


def negatives_within(anchors: Rows, positive: np.ndarray, rows: Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, row, score)``: the best ``k`` rows of other labels between the limits. An anchor here is a pair with a positive."""
    lo, hi = limits(positive)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    starts, label, low, high, least, most = window_bounds(rows)
    stops = np.append(starts[1:], len(rows))
    for begin in range(0, len(anchors), 1024):
        part = np.arange(begin, min(begin + 1024, len(anchors)))
        some = anchors.take(part)
        lower, upper = score_bounds(some.norm, some.angles, low, high, least, most)
        wanted = (some.label[:, None] != label[None, :]) & (upper >= lo[part, None]) & (lower <= hi[part, None]) & (lo <= hi)[part, None]
        for w in np.flatnonzero(wanted.any(axis=0)):
            who = part[wanted[:, w]]
            inside = np.arange(starts[w], stops[w])
            score = scores(anchors.take(who), rows.take(inside))
            a, r = np.nonzero((score >= lo[who, None]) & (score <= hi[who, None]))
            keep = _best(who[a], score[a, r], rows.id[inside[r]], k)
            found.append((who[a][keep], inside[r][keep], score[a, r][keep]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, r, s = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = _best(a, s, rows.id[r], k)
    return a[keep], r[keep], s[keep]


def _summed(rows: pa.Table) -> pa.Table:
    """The windows of a block's candidates, each as one row."""
    block = rows.column("block")[0].as_py()
    rows = rows.filter(rows.column("candidate"))
    if not rows.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "label": pa.array([], pa.int32()), "bounds": pa.array([], pa.binary())})
    held = Rows(_ordered(rows))
    _, label, low, high, least, most = window_bounds(held)
    bounds = np.hstack([low, high, least[:, None], most[:, None]])
    return pa.table({"block": pa.array(np.full(len(label), block)), "label": pa.array(label), "bounds": packed(bounds)})


def _ordered(rows: pa.Table) -> pa.Table:
    """Rows of a block by label, and by their angles within it."""
    label = rows.column("label").to_numpy()
    angles = unpacked(rows.column("angles"), np.float64)
    order = np.lexsort((rows.column("vec_id").to_numpy(), angles.min(axis=1), angles.argmin(axis=1), label))
    return rows.take(pa.array(order))


def _own(k: int) -> callable:
    """Anchors of a block with the score that their positives must reach: the ``k``-th best within the block."""

    def run(rows: pa.Table) -> pa.Table:
        anchors = rows.filter(rows.column("anchor"))
        candidates = rows.filter(rows.column("candidate"))
        need = np.full(anchors.num_rows, np.iinfo(np.int64).min)
        if anchors.num_rows and candidates.num_rows:
            a, _, score = positives_within(Rows(anchors), need, Rows(_ordered(candidates)), k)
            full = np.bincount(a, minlength=anchors.num_rows) == k
            worst = np.full(anchors.num_rows, np.iinfo(np.int64).max)
            np.minimum.at(worst, a, score)
            need = np.where(full, worst, need)
        return anchors.select(["vec_id", "label", "ints", "norm", "angles"]).append_column("need", pa.array(need))

    return run


def _routed(positive: bool) -> callable:
    """``(block, vec_id, …)``: the blocks that have a window an anchor must be scored with."""

    def run(anchors: pa.Table, windows: pa.Table) -> pa.Table:
        to_block: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        if anchors.num_rows and windows.num_rows:
            some = Rows(anchors)
            label, block = windows.column("label").to_numpy(), windows.column("block").to_numpy()
            bounds = unpacked(windows.column("bounds"), np.float64)
            j = (bounds.shape[1] - 2) // 2
            low, high, least, most = bounds[:, :j], bounds[:, j : 2 * j], bounds[:, -2], bounds[:, -1]
            places, place = np.unique(block, return_inverse=True)
            need = anchors.column("need").to_numpy()
            lo, hi = limits(need) if not positive else (need, need)
            for begin in range(0, len(some), 256):
                part = slice(begin, begin + 256)
                lower, upper = score_bounds(some.norm[part], some.angles[part], low, high, least, most)
                same = some.label[part, None] == label[None, :]
                wanted = same & (upper >= lo[part, None]) if positive else ~same & (upper >= lo[part, None]) & (lower <= hi[part, None])
                a, w = np.nonzero(wanted)
                pair = np.unique(a * len(places) + place[w])
                rows.append(begin + pair // len(places))
                to_block.append(places[pair % len(places)])
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        block = np.concatenate(to_block) if to_block else np.zeros(0, np.int64)
        out = anchors.select(["vec_id", "label", "ints", "norm", "angles", "need", "positive_id"]).take(pa.array(at))
        return out.append_column("block", pa.array(block))

    return run


def _scored(positive: bool, k: int) -> callable:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        a = r = s = np.zeros(0, np.int64)
        if rows.num_rows and anchors.num_rows:
            held, some, need = Rows(_ordered(rows)), Rows(anchors), anchors.column("need").to_numpy()
            a, r, s = positives_within(some, need, held, k) if positive else negatives_within(some, need, held, k)
            found = held.id[r]
        else:
            found = r
        of = anchors.select(["vec_id", "positive_id", "need"]).take(pa.array(a))
        return pa.table([of.column(0), of.column(1), of.column(2), pa.array(found), pa.array(s)], ["anchor_id", "positive_id", "need", "found_id", "score"])

    return run


_ANCHOR = "vec_id long, label int, ints binary, norm double, angles binary, need long, positive_id long"
_FOUND = "anchor_id long, positive_id long, need long, found_id long, score long"


def _search(anchors: DataFrame, blocks: DataFrame, windows: DataFrame, positive: bool, k: int, total: int) -> DataFrame:
    """``anchors`` with ``need`` against all rows whose windows may matter."""
    salts = 1 + total // VISITORS
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")
    chunks = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = anchors.select(
        *[F.col(c).alias(c) for c in anchors.columns], salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(_chunks(windows) - 1))).alias("chunk")
    )
    routed = asked.groupBy("chunk", "salt").cogroup(chunks.groupBy("chunk", "salt")).applyInArrow(_routed(positive), f"{_ANCHOR}, block long")
    routed = written(routed.withColumn("salt", salt), "routed")
    held = blocks.where("candidate").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = held.groupBy("block", "salt").cogroup(routed.groupBy("block", "salt")).applyInArrow(_scored(positive, k), _FOUND)
    by = Window.partitionBy("anchor_id", *[] if positive else ["positive_id"]).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _chunks(windows: DataFrame) -> int:
    return (windows.agg(F.max("chunk")).first()[0] or 0) + 1


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` → ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``; of those with an id divisible by 7 the label
    counts as the next of ten.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = sound_vectors(vectors.select("vec_id", label.alias("label"), "embedding").where("label is not null"))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = one_per_id(rows.select("vec_id", "label", ints.alias("ints")), F.struct("label", "ints"))
    rows = rows.where(F.aggregate("ints", F.lit(0.0), lambda total, x: total + x * x) < 2.0**62)
    keep = max(positives + 1, negatives)
    copies = Window.partitionBy("label", "ints").orderBy("vec_id")
    ranked = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= keep).select("vec_id", "label", "ints", F.lit(True).alias("candidate"))
    # other copies matter as anchors only
    anchor = F.col("vec_id") % every == 0
    ranked = written(ranked, "candidates")
    others = rows.where(anchor).join(ranked.where(anchor).select("vec_id"), "vec_id", "left_anti")
    rows = written(ranked.unionByName(others.withColumn("candidate", F.lit(False))), "int-vectors")

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("ints").collect()
    directions = spread_out(np.array([r.ints for r in sample] or [[0.0]], np.float64), REFERENCES)
    angled = rows.mapInArrow(_angled(directions), f"{VECTOR}, home int, angle double")
    order = ["label", "home", "angle", "vec_id"]
    blocks = angled.repartitionByRange(*order).sortWithinPartitions(*order).drop("home", "angle").mapInArrow(_numbered, f"{VECTOR}, block long")
    blocks = written(blocks, "blocks")
    windows = blocks.groupBy("block").applyInArrow(_summed, "block long, label int, bounds binary")
    windows = written(windows, "windows")
    numbers = Window.orderBy("block")
    by_block = windows.select("block").distinct().withColumn("chunk", F.floor((F.row_number().over(numbers) - 1) / CHUNK).cast("int"))
    windows = written(windows.join(by_block, "block"), "window-chunks")

    anchors = blocks.withColumn("anchor", anchor).groupBy("block").applyInArrow(
        _own(positives), "vec_id long, label int, ints binary, norm double, angles binary, need long"
    )
    anchors = written(anchors.withColumn("positive_id", F.lit(None).cast("long")), "anchors")
    total = anchors.count()
    near = _search(anchors, blocks, windows, True, positives, total)
    near = written(near.select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("need")), "positives")
    pairs = anchors.drop("need", "positive_id").join(near.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    pairs = written(pairs.select("vec_id", "label", "ints", "norm", "angles", "need", "positive_id"), "anchor-positives")
    far = _search(pairs, blocks, windows, False, negatives, total * positives)
    return far.select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), F.col("need").alias("positive_score"), F.col("score").alias("negative_score")
    )
