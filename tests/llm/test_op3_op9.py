"""Repeated passages and near-duplicates against brute force."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
import numpy as np
import pyarrow as pa

from runscope.llm import op3_substring_dedup as op3, op9_jaccard_join as op9
from runscope.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, score string, ranges string"


def words(text):
    return WORD.findall(text or "")


def texts(seed, n):
    """Texts over few words, with shared passages, copies, near copies and odd white space."""
    rng = random.Random(seed)
    pick = lambda k: [rng.choice("a b c dé É the of, x1".split()) for _ in range(k)]
    shared = [pick(20) for _ in range(4)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and out:
            out.append(rng.choice(out))
        elif kind < 0.45 and out:
            w = words(rng.choice(out))
            for _ in range(rng.randint(1, 2)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(["new", "other", "é"])
            out.append("  ".join(w))
        else:
            parts = pick(rng.randint(0, 40)) + (rng.choice(shared) if rng.random() < 0.6 else []) + pick(rng.randint(0, 15))
            out.append("".join(p + rng.choice([" ", "\n", "\t", "\r\n", "\x0b "]) for p in parts))
    return out + [None, "", " \n", "word", "two words", "x " * 300]


def rows(seed, n=60):
    docs = [(i * 3 + 1, t, "s", None) for i, t in enumerate(texts(seed, n))]
    docs += [docs[0], docs[2], (None, docs[1][1], None, None), (7, docs[5][1], None, None)]  # repeated ids, no id
    random.Random(seed).shuffle(docs)
    return docs


def brute_repeats(docs):
    first = {}
    big = op3.NAMELESS
    for doc, text, *_ in docs:
        w = words(text)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, big), big if doc is None else doc)
    out = []
    for doc, text, *_ in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < (big if doc is None else doc):
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    docs = rows(seed)
    got = op3.remove_repeats_digest(spark.createDataFrame(docs, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_repeats(docs), key=str)


def test_repeats_keep_the_text_itself(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    got = op3.remove_repeats(spark.createDataFrame([(1, f"a {passage} b"), (2, f"{passage}\nc"), (3, passage[3:])], "doc_id long, text string"))
    assert {r.doc_id: r.kept for r in got.collect()} == {1: f"a {passage} b", 2: "c", 3: passage[3:]}


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op3.remove_repeats_digest(empty).collect() == []
    assert op9.near_duplicates(empty).collect() == []


def test_different_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(op3, "window_hash", lambda hashes, width, salt=0: np.zeros(max(0, len(hashes) - width + 1), np.uint64))
    bucket = op3.Bucket()
    a, b = [" ".join(f"{c}{i}" for i in range(13)).encode() for c in "ab"]
    bucket.add([a, b], [5, 3])
    bucket.add([a], [4])
    bucket.finish()
    hashes = np.array([op3._hash(a), op3._hash(b)], np.uint64)
    who, begin, end = bucket.repeated(hashes, np.array([5, 5]), np.array([0, 2], np.int32))
    assert (who.tolist(), begin.tolist(), end.tolist()) == ([0, 1], [0, 2], [13, 15])
    assert bucket.repeated(hashes, np.array([4, 3]), np.array([0, 2], np.int32))[0].tolist() == []


def shingles(text, width=3):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def brute_components(docs, percent=90, width=3):
    sets = [(d, shingles(t, width)) for d, t, *_ in docs]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if d is not None and e is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return [(d, len(x), None if d is None else find(d)) for d, x in sets]


@pytest.mark.parametrize(("seed", "rounds", "block"), [(1, 2, 4096), (2, 0, 4096), (3, 1, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, rounds, block):
    monkeypatch.setattr(op9, "ROUNDS", rounds)
    monkeypatch.setattr(op9, "BLOCK", block)
    docs = rows(seed, 90)
    long = " ".join(f"v{i}" for i in range(120)).split()
    for k in range(25):  # a chain: neighbours are similar, the ends are not
        long[4 * k] = f"n{k}"
        docs.append((1000 + k, " ".join(long), None, None))
    got = op9.near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(4))
    want = brute_components(docs)
    assert len({c for _, _, c in want}) < len({d for d, _, _ in want})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("docs", [[(2, "x a b c"), (3, "y d e f"), (5, "x a b c"), (5, "y d e f")], [(2, "x a b"), (3, "y d e"), (5, "x a b"), (5, "y d e"), (5, None), (1, "y d e"), (None, "x a b")]])
def test_texts_of_one_id_link_their_classes(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, op9.near_duplicates(frame).collect()), key=str)
    assert got == sorted(brute_components(docs), key=str) and len({c for d, _, c in got if d}) == 1


def test_one_document_of_each_group_stays(spark):
    docs = rows(5, 40)
    kept = op9.one_per_group(spark.createDataFrame(docs, SCHEMA))
    want = sorted((r for r, (d, _, c) in zip(docs, brute_components(docs)) if d is None or c == d), key=str)
    assert kept.columns == ["doc_id", "text", "score", "ranges"]
    assert sorted(map(tuple, kept.collect()), key=str) == want


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400))
def test_filters_leave_room_for_every_similar_pair(n, m):
    need = int(op9._least_overlap(np.array(n), np.array(m), 90))
    small, large = sorted((n, m))
    for common in range(small + 1):
        similar = 100 * common >= 90 * (n + m - common)
        assert similar == (common >= need)
    if need <= small:  # similar sets share a shingle within their prefixes
        assert op9.prefix_length(np.array(n), 90) >= n - need + 1 and op9.prefix_length(np.array(m), 90) >= m - need + 1


def test_components_of_paths_stars_and_pairs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(80)] + [(900, 901), (901, 900), (950, 950)]
    rng.shuffle(edges)
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(100, 161)), list(range(500, 581)), [900, 901]]


def test_shingle_sets_are_distinct_and_ordered():
    text, value = op9.shingle_sets(pa.array(["a b c a b c", "A B c", "", "one", "one two"], pa.large_string()))
    assert text.tolist() == [0, 0, 0, 1, 3, 4]
    assert value[3] in value[:3]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 3000), st.integers(0, 3000), st.integers(0, 99))
def test_sketches_never_say_more_than_differs(n, m, common, seed):
    rng = np.random.default_rng(seed)
    common = min(common, n, m)
    pool = np.unique(rng.integers(0, 2**63, n + m, np.uint64))[: n + m - common]
    x, y = pool[:n], pool[len(pool) - m :] if len(pool) >= m else pool
    a, b = (op9._sketches(np.zeros(len(s), np.int64), s, 1)[0] for s in (x, y))
    assert op9.sketch_distance(a, b) == op9.sketch_distance(b, a) <= len(np.setxor1d(x, y))
    assert op9.sketch_distance(a, a) == 0 and len(a) * 8 >= len(x)


def test_shingles_with_few_postings_are_filtered_many_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from runscope.llm import op9_jaccard_join as op9

    rng, k = np.random.default_rng(5), 3000
    token, node = np.sort(rng.integers(0, 900, k)), rng.integers(0, 800, k)
    n, place = rng.integers(20, 40, k).astype(np.int32), rng.integers(0, 5, k).astype(np.int32)
    order = np.lexsort((n, token))
    n, rest, bitmap = n[order], rng.integers(0, 2, (k, op9.BINS)).astype(np.uint8), rng.integers(0, 1 << 6, (k, 64)).astype(np.uint8)
    calls, real = [], op9.prefix_filters
    monkeypatch.setattr(op9, "prefix_filters", lambda *args: calls.append(1) or real(*args))
    columns = [pa.array(token), pa.array(node), pa.array(n), pa.array(place), op9._rows_of(rest)]
    batch = pa.record_batch(columns, op9.POSTING)
    got = [r for b in op9._shared(iter([batch.slice(0, 1000), batch.slice(1000)]), 60) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(calls) < 10
    a, b = np.triu_indices(k, 1)
    same = (token[a] == token[b]) & (node[a] != node[b])
    a, b = a[same], b[same]
    fits = real(n.astype(np.int64), place.astype(np.int64), rest, a, b, 60)[0]
    keep = np.unique(np.concatenate([a[fits], b[fits]]))
    assert got == list(zip(*(c.take(pa.array(keep)).to_pylist() for c in columns), strict=True)) and 0 < len(got) < k

    wide = pa.record_batch([*columns, op9._rows_of(bitmap), pa.array(node // 2)], [*op9.POSTING, "bitmap", "label"])
    calls.clear()
    found = {r for b in op9._candidates(60, True)(iter([wide])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert len(calls) < 10
    postings = op9.Postings([node, n.astype(np.int64), place.astype(np.int64), rest, bitmap, node // 2], 60)
    d = postings.distance(a, b)
    ends = np.sort(np.stack([node[a], node[b]]), axis=0)
    assert found == set(zip(*ends[:, d >= 0].tolist(), d[d >= 0].tolist(), strict=True))
