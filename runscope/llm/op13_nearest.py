"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few random directions, shifted, and ordered along a Hilbert curve; ``ORDERINGS``
such orderings, each with its own directions and shift, are range-partitioned by Spark. In each, a query
looks at the rows within ``window`` places of its own, and what the orderings find is merged and ranked by
the exact distance on the original vectors.

The window is fitted: the true neighbours of a bounded sample of queries (``SAMPLE``) are found by comparing
them with all rows, and the window is the least that holds ``TARGET`` of them in some ordering, at least
``LEAST_WINDOW``. So it is narrow where neighbours are telling and wide where vectors have no structure, as
the orderings of random vectors say little: there the search costs about as much as comparing all.

Equal vectors are searched as one, which keeps its ``neighbours + 1`` smallest ids: no query can have more
of them among its nearest. So a vector that a third of all rows have is one point on the curves.

Rows without a usable vector take no part (see ``sound_vectors``; zero vectors neither). Of rows with the
same id the one with the least vector counts. Fewer candidates than asked for are all returned; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from runscope.llm.tables import measured, written
from runscope.llm.vectors import matrix, one_per_id, packed, sound_vectors, unpacked

ORDERINGS, DIRECTIONS, BITS = 8, 8, 7
#: Queries whose true neighbours are found to fit the window, and the share of them that it holds.
SAMPLE, TARGET = 256, 0.95
LEAST_WINDOW = 512
#: Rows of a block, and queries that visit a block at a time.
BLOCK, VISITORS = 4096, 8192
SEED = 13


def directions(width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ordering orthonormal directions and shifts (in cells of the grid)."""
    rng = np.random.default_rng(SEED)
    n = min(DIRECTIONS, width)
    made = []
    for _ in range(ORDERINGS):
        turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
        made.append((turn[:, :n], rng.uniform(-0.125, 0.125, n)))
    return made


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates below ``2**bits``.

    The coordinates are turned level by level, from the coarsest, so that the sub-cubes follow each
    other; their Gray code, read across the axes, is the place.
    """
    x = cells.astype(np.uint32)
    axes = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for axis in range(axes):
            upper = (x[:, axis] & bit) != 0
            flip = np.where(upper, below, (x[:, 0] ^ x[:, axis]) & below).astype(np.uint32)
            x[:, 0] ^= flip
            x[:, axis] ^= np.where(upper, np.uint32(0), flip) if axis else np.uint32(0)
    for axis in range(1, axes):
        x[:, axis] ^= x[:, axis - 1]
    carry = np.zeros(len(x), np.uint32)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[:, -1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0)).astype(np.uint32)
    x ^= carry[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = key << 1 | (x[:, axis] >> np.uint32(level) & 1)
    return key


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances of pairs of rows, summed component by component."""
    total = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        apart = query[..., k] - rows[:, k]
        total += apart * apart
    return np.sqrt(total)


def nearest(queries: np.ndarray, rows: np.ndarray, nodes: np.ndarray, k: int, inside: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places and distances of its ``k`` nearest rows, ties to the smaller node.

    A matrix product tells which rows can be among them; those are measured exactly.
    """
    size, own = (rows * rows).sum(axis=1), (queries * queries).sum(axis=1)
    for begin in range(0, len(queries), 256):
        part = slice(begin, begin + 256)
        near = own[part, None] + size[None, :] - 2.0 * (queries[part] @ rows.T)
        slack = 1e-9 * (own[part, None] + size[None, :])
        if inside is not None:
            near[~inside[part]] = np.inf
        limit = np.partition(near + slack, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(near), np.inf)
        maybe = (near - slack <= limit[:, None]) & (near < np.inf)
        for i in range(len(near)):
            at = np.flatnonzero(maybe[i])
            d = distances(queries[begin + i], rows[at])
            best = np.lexsort((nodes[at], d))[:k]
            yield begin + i, at[best], d[best]


def _moments(plan: list) -> callable:
    """Count, sums and sums of squares of the projections of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = np.hstack([matrix(batch.column("embedding")) @ turn for turn, _ in plan])
                part = np.vstack([y.sum(axis=0), (y * y).sum(axis=0)])
                total = (part, batch.num_rows) if total is None else (total[0] + part, total[1] + batch.num_rows)
        if total is not None:
            axis = np.arange(total[0].shape[1])
            yield pa.record_batch([pa.array(axis), pa.array(np.full(len(axis), total[1])), pa.array(total[0][0]), pa.array(total[0][1])], ["axis", "n", "s", "q"])

    return run


def _keyed(plan: list, middle: np.ndarray, scale: np.ndarray) -> callable:
    """A row per vector and ordering, with its place on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("embedding"))
            for k, (turn, shift) in enumerate(plan):
                n = turn.shape[1]
                y = (vectors @ turn - middle[k * n : (k + 1) * n]) / scale[k * n : (k + 1) * n] / 8 + 0.5 + shift
                cells = np.clip(y * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint32)
                yield pa.record_batch(
                    [pa.array(np.full(len(cells), k, np.int32)), pa.array(hilbert_keys(cells, BITS)), batch.column("node"), batch.column("asked"), packed(vectors)],
                    ["ordering", "key", "node", "asked", "vector"],
                )

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and a row's place among the partition's rows of its ordering."""
    part, last, seen = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ordering = batch.column("ordering").to_numpy()
        place = np.arange(batch.num_rows) - np.searchsorted(ordering, ordering)
        place += np.where(ordering == last, seen, 0)
        last, seen = int(ordering[-1]), int(place[-1]) + 1
        columns = [batch.column(c) for c in ("ordering", "node", "asked", "vector")]
        yield pa.record_batch([*columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], ["ordering", "node", "asked", "vector", "part", "place"])


def _compared(sample: list[tuple[int, bytes]], k: int) -> callable:
    """The nearest of a task's rows to each query of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = np.array([i for i, _ in sample]), np.vstack([np.frombuffer(v, np.float64) for _, v in sample])
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column("node").to_numpy()
            for q, at, d in nearest(queries, matrix(batch.column("embedding")), nodes, k):
                node = nodes[at]
                if q in best:
                    node, d = np.concatenate([best[q][0], node]), np.concatenate([best[q][1], d])
                    order = np.lexsort((node, d))[:k]
                    node, d = node[order], d[order]
                best[q] = node, d
        for q, (node, d) in best.items():
            yield pa.record_batch([pa.array(np.full(len(node), ids[q])), pa.array(node), pa.array(d)], ["query", "node", "d"])

    return run


def _visited(k: int, window: int) -> callable:
    """Queries in a block: each with the nearest of the rows within its window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            rank, nodes = left.column("rank").to_numpy(), left.column("node").to_numpy()
            rows = unpacked(left.column("vector"), np.float64)
            ids, at = right.column("query").to_numpy(), right.column("at").to_numpy()
            queries = unpacked(right.column("vector"), np.float64)
            for begin in range(0, len(ids), 1024):
                part = slice(begin, begin + 1024)
                inside = np.abs(rank[None, :] - at[part, None]) <= window
                for q, place, d in nearest(queries[part], rows, nodes, k, inside):
                    found.append((np.full(len(place), ids[begin + q]), nodes[place], d))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table(columns, ["query", "node", "d"])

    return run


def _first(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def fitted_window(points: DataFrame, ordered: DataFrame, k: int) -> int:
    """The window that holds ``TARGET`` of the true neighbours of a sample of queries in some ordering."""
    chosen = points.where("asked").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("node", "embedding").collect()
    sample = [(r.node, np.array(r.embedding, np.float64).tobytes()) for r in chosen]
    if not sample:
        return LEAST_WINDOW
    found = points.select("node", "embedding").mapInArrow(_compared(sample, k), "query long, node long, d double")
    true = written(_first(found, "query", ["d", "node"], k).select("query", "node"), "true-neighbours")  # SAMPLE * k rows at most
    needed = measured(true.select(F.explode(F.array("query", "node")).alias("node")).distinct(), "needed")
    ranks = written(ordered.select("ordering", "node", "rank").join(needed, "node"), "sample-ranks")
    a = ranks.select("ordering", F.col("node").alias("query"), F.col("rank").alias("at"))
    apart = true.join(a, "query").join(ranks, ["ordering", "node"]).groupBy("query", "node").agg(F.min(F.abs(F.col("rank") - F.col("at"))).alias("apart"))
    spread = apart.agg(F.percentile("apart", TARGET)).first()[0]
    return max(LEAST_WINDOW, int(np.ceil(spread or 0)))


def nearest_neighbours(vectors: DataFrame, every: int = 100, neighbours: int = 10) -> DataFrame:
    """``vectors(vec_id, embedding)`` → ``(query_id, rank, vec_id, score)``.

    Queries are the rows whose id is divisible by ``every``; candidates all others.
    """
    k = neighbours + 1  # a query finds itself
    rows = one_per_id(sound_vectors(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), nonzero=True), F.col("embedding"))
    rows = written(rows, "vectors")
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    firsts = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k)
    points = firsts.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("embedding").agg(F.count("*").alias("n"))
    points = written(points.join(asking, "embedding", "left").select("node", "ids", "embedding", F.col("n").isNotNull().alias("asked")), "points")

    head = points.first()
    width = len(head.embedding) if head else 1
    plan = directions(width)
    sums = points.mapInArrow(_moments(plan), "axis long, n long, s double, q double").groupBy("axis").agg(F.sum("n"), F.sum("s"), F.sum("q"))
    table = np.array(sorted(map(tuple, sums.collect()))).reshape(-1, 4)  # a row per direction
    count = np.maximum(table[:, 1], 1)
    middle = table[:, 2] / count
    scale = np.sqrt(np.maximum(table[:, 3] / count - middle**2, 0))
    scale[scale == 0] = 1.0

    keyed = points.select("node", "asked", "embedding").mapInArrow(_keyed(plan, middle, scale), "ordering int, key long, node long, asked boolean, vector binary")
    placed = (
        keyed.repartitionByRange("ordering", "key", "node")
        .sortWithinPartitions("ordering", "key", "node")
        .mapInArrow(_placed, "ordering int, node long, asked boolean, vector binary, part int, place long")
    )
    placed = written(placed, "curves")
    # one row per ordering and partition
    parts = placed.groupBy("ordering", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = measured(parts.select("ordering", "part", F.coalesce(before, F.lit(0)).alias("before")), "parts")
    ordered = placed.join(parts, ["ordering", "part"]).select("ordering", "node", "asked", "vector", (F.col("before") + F.col("place")).alias("rank"))

    window = fitted_window(points, ordered, k)
    total, asked = points.count(), points.where("asked").count()
    salts = 1 + int(min(total, 2 * window + BLOCK) * (asked / max(total, 1)) // VISITORS)
    blocks = ordered.select("ordering", F.floor(F.col("rank") / BLOCK).alias("block"), "node", "rank", "vector")
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) if salts > 1 else blocks.withColumn("salt", F.lit(0))
    reach = F.sequence(
        F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / BLOCK), F.floor(F.least(F.col("rank") + window, F.lit(max(total - 1, 0))) / BLOCK)
    )
    visits = ordered.where("asked").select(
        F.col("ordering").alias("ordering"), F.explode(reach).alias("block"), F.col("node").alias("query"), F.col("rank").alias("at"), F.col("vector").alias("vector"), F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int").alias("salt")
    )
    keys = ["ordering", "block", "salt"]
    found = blocks.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_visited(k, window), "query long, node long, d double")
    merged = _first(found.distinct(), "query", ["d", "node"], k).select("query", "node", "d")

    # from distinct vectors to rows
    at = merged.join(points.select("node", "ids"), "node").select("query", "d", F.explode("ids").alias("vec_id"))
    asking = rows.where(F.col("vec_id") % every == 0).join(points.select("embedding", F.col("node").alias("query")), "embedding")
    pairs = asking.select("query", F.col("vec_id").alias("query_id")).join(at, "query").where("query_id <> vec_id")
    return _first(pairs, "query_id", ["d", "vec_id"], neighbours).select("query_id", "rank", "vec_id", F.col("d").alias("score"))
