"""Hard negatives, spelling variants and nearest neighbours against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runscope.llm import op11_hard_negatives as op11, op12_spelling as op12, op13_nearest as op13
from runscope.llm.common import read

VECTORS = "vec_id long, embedding array<float>, label int, rank string, node string"


def vector_rows(seed, n=700, width=6):
    """Clusters, a vector that a third of the rows have, near copies, ties, and rows that take no part."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((5, width))
    out = []
    for i in range(n):
        kind = rng.random()
        v = rng.standard_normal(width) if kind < 0.3 else middle[rng.integers(5)] + 0.05 * rng.standard_normal(width)
        if kind > 0.66:
            v = middle[0]
        if 0.5 < kind < 0.55:
            v = np.round(v)  # ties
        out.append([i * 2, [float(np.float32(x)) for x in v], int(rng.integers(4)), "x", None])
    out[5][1] = [0.0] * width
    out[6][1] = None
    out[7][1][2] = None
    out[8][1][1] = float("nan")
    out[9][1][0] = float("inf")
    out[10][2] = None
    out[11][1] = out[11][1][:-1]
    out[12][1] = []
    out[13][0] = None
    out.append(list(out[20]))  # a repeated row
    return out


def usable(rows, zero, labelled):
    seen = {}
    for i, v, label, *_ in rows:
        if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all() and (zero or any(v)) and (label is not None or not labelled):
            seen[i] = (np.array(v, float), label)
    return seen


def brute_negatives(rows):
    found = usable(rows, True, True)
    ids = np.array(list(found))
    label = np.array([(found[i][1] + 1) % 10 if i % 7 == 0 else found[i][1] for i in ids.tolist()])
    ints = np.array([np.floor(256 * found[i][0]) for i in ids.tolist()]).astype(np.int64)
    out = set()
    for at in np.flatnonzero(ids % 50 == 0):
        score = ints @ ints[at]
        order = [i for i in np.lexsort((ids, -score)) if i != at]
        for p in [i for i in order if label[i] == label[at]][:5]:
            fits = [i for i in order if label[i] != label[at] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out |= {(int(ids[at]), int(ids[p]), r, int(ids[i]), int(score[p]), int(score[i])) for r, i in enumerate(fits, 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, seed):
    rows = vector_rows(seed)
    got = op11.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_negatives(rows)


def test_hard_negatives_of_nothing_and_of_large_components(spark):
    assert op11.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    # products beyond what floating point holds exactly, and a vector beyond 64 bits
    rows = [[0, [3e5, 1.0], 0], [1, [3e5, 1.0 / 256], 1], [2, [2e5 + 1 / 256, 0.0], 2], [3, [2e5, 0.0], 2], [4, [1e30, 0.0], 2]]
    got = op11.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    top = 76_800_000
    assert [tuple(r) for r in sorted(got)] == [
        (0, 1, 1, 2, top * top + 256, top * 51_200_001), (0, 1, 2, 3, top * top + 256, top * 51_200_000),
    ]


def test_score_bounds_hold(spark):
    rng = np.random.default_rng(3)
    ints = np.vstack([np.floor(256 * rng.standard_normal((600, 5))), np.zeros((1, 5))])
    directions = op11.spread_out(ints[:50], 4)
    norm = np.linalg.norm(ints, axis=1)
    angles = np.arccos(np.clip(ints @ directions.T / np.maximum(norm, 1)[:, None], -1, 1))
    rows = object.__new__(op11.Rows)
    rows.label, rows.angles, rows.norm = np.sort(rng.integers(3, size=len(ints))), angles, norm
    starts, _, *bounds = op11.window_bounds(rows)
    lower, upper = op11.score_bounds(norm, angles, *bounds)
    score = ints @ ints.T
    for w, (a, b) in enumerate(zip(starts, [*starts[1:], len(ints)], strict=True)):
        assert (lower[:, w] <= score[:, a:b].min(axis=1)).all() and (upper[:, w] >= score[:, a:b].max(axis=1)).all()
    assert (np.abs(upper) < 1.01 * norm.max() ** 2 + 2).all()


def test_limits_are_the_integers_between():
    for p in [-7, -1, 0, 1, 2, 3, 19, 20, 21, 99, 100, 101, 10**17 + 7]:
        lo, hi = op11.limits(np.array([p]))
        assert int(lo[0]) == -((-50 * p) // 100) and int(hi[0]) == 95 * p // 100


def brute_near(words):
    near, cut = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            cut[i, shorter].add(w)
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in cut.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute_spelling(rows):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    letters = {chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}
    for doc, text, *_ in rows:
        for run in "".join(c if c in letters else " " for c in text or "").split():
            run = run.translate(table)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = brute_near(words)
    form = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f and words[f] >= 10 * words[w] else None for w, f in form.items()}
    out = set()
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out.add((w, form[w], end, words[w], len(near[w]), words.get(form[w])))
    return out


DOCUMENTS = "doc_id long, text string, word string, n string"


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdéÀÿx") for _ in range(rng.randint(6, 11))) for _ in range(60)]
    pool = []
    for w in base:
        pool += [w] * rng.choice([2, 30, 400])
        for _ in range(4):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "z" + w[i + 1 :], w[: i + 1] + w[i:], "".join(sorted(w))])
            pool += [v] * rng.choice([1, 2, 3, 39])
    pool += ["aaaaaaa", "aaaaaaaa", "aaaaaaaab"] * 3 + ["m" * 3000, "m" * 3001, "m" * 3001, "m" * 3000] * 3 + ["Été×Àÿçî"] * 40
    rng.shuffle(pool)
    rows = [(i, rng.choice([" ", ", ", "1", "\n"]).join(w.title() if rng.random() < 0.2 else w for w in pool[i * 50 : i * 50 + 50]), "x", None) for i in range(len(pool) // 50 + 1)]
    rows += [(900, None, None, None), (901, "", None, None), (None, rows[0][1], None, None), rows[3]]
    got = op12.spelling_variants(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert len({r.word for r in got}) == len(got)
    assert {tuple(r) for r in got} == brute_spelling(rows)


def test_spelling_variants_of_the_small_tables(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    got = {tuple(r) for r in op12.spelling_variants(docs).collect()}
    assert got == brute_spelling(docs.select("doc_id", "text").collect()) and any(r[1] for r in got)
    assert op12.spelling_variants(docs.where("false")).collect() == []


def test_edits_are_verified_in_both_directions():
    words = ["abcdefg", "abcdefgg", "xabcdefg", "abcdxefg", "abcdegf", "abcdefh", "gabcdef", "aabcdefg"]
    by_size = {n: sorted((w for w in words if len(w) == n), key=lambda w: (op12.signatures([w]).tolist(), w)) for n in (7, 8)}
    a, b = op12.Block(by_size[7]), op12.Block(by_size[8])
    pairs = {(by_size[7][i], by_size[8][j]) for i, j in zip(*op12.near_words(a, b, False), strict=True)}
    pairs |= {(by_size[7][i], by_size[7][j]) for i, j in zip(*op12.near_words(a, a, True), strict=True)}
    expected = {(w, v) for w, near in brute_near(set(words)).items() for v in near}
    assert {p for x in pairs for p in (x, x[::-1])} == expected - {p for p in expected if len(p[0]) == len(p[1]) == 8}


def brute_nearest(rows, every, k):
    found = usable(rows, False, False)
    ids = np.array(list(found))
    vectors = np.array([found[i][0] for i in ids.tolist()])
    out = set()
    for at in np.flatnonzero(ids % every == 0):
        d = op13.distances(vectors[at], vectors)
        order = [i for i in np.lexsort((ids, d)) if i != at][:k]
        out |= {(int(ids[at]), r, int(ids[i]), float(d[i])) for r, i in enumerate(order, 1)}
    return out


def test_curves_visit_neighbouring_cells():
    for axes, bits in ((2, 4), (3, 3), (5, 2), (1, 6)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
        keys = op13.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        along = cells[np.argsort(keys)].astype(int)
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [700, 9])
def test_nearest_neighbours_are_exact_while_windows_hold_all_rows(spark, n):
    rows = vector_rows(7, max(n, 21))[: n if n < 21 else None]
    got = op13.nearest_neighbours(spark.createDataFrame(rows, VECTORS)).collect()
    if n == 700:  # 233 copies are one point, so the window reaches all
        assert {tuple(r) for r in got} == brute_nearest(rows, 100, 10)
    assert op13.nearest_neighbours(spark.createDataFrame([], VECTORS)).collect() == []


def test_recall_on_vectors_without_structure(spark):
    table = read(spark, "/root/testdata/sf0.1", "embeddings")
    got = op13.nearest_neighbours(table, every=20).collect()
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = 0
    found = defaultdict(dict)
    for r in got:
        found[r.query_id][r.vec_id] = r
    for q, near in found.items():
        at = int(np.flatnonzero(ids == q)[0])
        d = op13.distances(vectors[at], vectors)
        d[at] = np.inf
        hits += len({int(ids[i]) for i in np.lexsort((ids, d))[:10]} & set(near))
        assert all(r.score == d[np.flatnonzero(ids == v)[0]] for v, r in near.items()) and len(near) == 10
    assert len(found) == (ids % 20 == 0).sum() and hits >= 0.9 * 10 * len(found)
