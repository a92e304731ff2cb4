"""Toxicity by a logistic model that identity terms must not sway.

Features are the presence of hashed words and of hashed byte 4-grams within words. The loss is the
log loss on labelled documents, plus an L2 penalty, plus for every document that names a group
(see ``SWAPS``) the squared change of its logit when the term is swapped, all through the text, for another
of the same kind. A document that names none is compared with itself plus a term. So naming a group can't
make a neutral text look toxic, also where a term shares 4-grams with an insult.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` of each label, the smallest by
hash). Every text is scored whole. Null texts count as empty; the score of a text without
known features is that of the intercept. Without labels of both kinds all scores are 0. Several
labels of a document count as toxic if one is. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runscope.llm.common import pieces, words_of
from runscope.llm.grams import grams, letters
from runscope.llm.op2_language import fold

#: Labelled documents of each label that the model is fitted on, at most.
SAMPLE = 3000
#: Buckets of features, as a power of two. Those count whose share differs between the labels by so
#: many standard errors.
BITS, MIN_ERRORS = 18, 4.0
L2, SWAP_PENALTY, STEPS, RATE = 1e-4, 1.0, 800, 0.05
THRESHOLD = 0.7
#: Bytes of text that are scored at a time; features take some 40 times as much.
PIECE_BYTES = 512 << 10
NOTHING = np.zeros(0, np.int64)
#: Terms that name a group, by kind; within a kind any may stand for any other.
SWAPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("mexican", "chinese", "indian", "american", "german", "french", "spanish", "turkish"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "old", "young"),
)


def word_bucket(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> (64 - BITS)


def features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, bucket)`` pairs, each once, ordered by text."""
    data, offsets = letters(list(texts))
    text, bucket = grams(data, offsets, 4, BITS, in_word=True)
    words = words_of(
        pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)]
        )
    )
    own = words.hashes(word_bucket).astype(np.int64)
    pairs = np.unique(np.concatenate([text << BITS | bucket, words.text << BITS | own]))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@cache
def term_buckets(swaps: tuple[tuple[str, ...], ...]) -> dict[bytes, np.ndarray]:
    return {term.encode(): features([term])[1] for terms in swaps for term in terms}


def counterfactuals(
    texts: Sequence[str], swaps: tuple[tuple[str, ...], ...] = SWAPS
) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each text its swaps: the buckets that the text as a whole loses, and those that it gains.

    Every term in the text is swapped for each other of its kind, wherever it stands. A text without any
    term gets one, which its bytes choose.
    """
    buckets = term_buckets(swaps)
    kind = {term.encode(): [other.encode() for other in terms] for terms in swaps for term in terms}
    data, offsets = letters(list(texts))
    raw, out = data.tobytes(), []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        words = raw[a:b].split()
        own: list[tuple[np.ndarray, np.ndarray]] = []
        for term in sorted(kind.keys() & set(words)):
            rest = features([b" ".join(w for w in words if w != term).decode()])[1]
            gone = np.setdiff1d(buckets[term], rest)
            own += [(gone, np.setdiff1d(buckets[other], rest)) for other in kind[term] if other != term]
        if not own and buckets:
            term = list(buckets)[xxhash.xxh3_64_intdigest(raw[a:b]) % len(buckets)]
            own.append((NOTHING, np.setdiff1d(buckets[term], features([raw[a:b].decode()])[1])))
        out.append(own)
    return out


def pooled(swaps: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Different swaps, and how often each happens."""
    times = Counter((gone.astype("<i8").tobytes(), new.astype("<i8").tobytes()) for gone, new in swaps)
    return [(n, np.frombuffer(gone, "<i8"), np.frombuffer(new, "<i8")) for (gone, new), n in sorted(times.items())]


def telling(x_text: np.ndarray, x_bucket: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Buckets whose share of documents differs between the labels beyond chance."""
    toxic = label[x_text] == 1
    n, m = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    a = np.bincount(x_bucket[toxic], minlength=1 << BITS)
    b = np.bincount(x_bucket[~toxic], minlength=1 << BITS)
    share = (a + b + 1) / (n + m + 2)
    errors = np.abs(a / n - b / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    return np.flatnonzero(errors >= MIN_ERRORS)


def train(
    x_text: np.ndarray, x_bucket: np.ndarray, label: np.ndarray, swaps: Sequence[tuple[int, np.ndarray, np.ndarray]],
    l2: float = L2, swap_penalty: float = SWAP_PENALTY, steps: int = STEPS, rate: float = RATE,
) -> tuple[np.ndarray, float]:
    """Weights per bucket and intercept, by Adam from zero (with its usual constants).

    Both labels weigh the same, whatever their share. ``swap_penalty`` is per document and swap, of
    ``swaps(times, buckets lost, buckets gained)``.
    """
    size = 1 << BITS
    used = telling(x_text, x_bucket, label)
    place = np.full(size, len(used))  # one place more, whose weight stays 0, for all the others
    place[used] = np.arange(len(used))
    keep = place[x_bucket] < len(used)
    text, col = x_text[keep], place[x_bucket[keep]]
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    # a swap is a row of signed buckets, of which only those with a weight matter
    share = np.array([n for n, _, _ in swaps], float) / max(1, len(label))
    parts = [p for _, gone, new in swaps for p in (gone, new)]
    size_of = [len(p) for p in parts]
    changed = place[np.concatenate([NOTHING, *parts])]
    swap = np.repeat(np.arange(len(parts)) // 2, size_of)
    sign = np.repeat(np.tile([-1.0, 1.0], len(swaps)), size_of)
    known = changed < len(used)
    changed, swap, sign = changed[known], swap[known], sign[known]
    w = np.zeros(len(used) + 2)  # the last is the intercept
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(text, weights=w[col], minlength=len(label)) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        g = np.zeros_like(w)
        g[:-2] = np.bincount(col, weights=error[text], minlength=len(used)) + l2 * w[:-2]
        g[-1] = error.sum()
        push = 2 * swap_penalty * share * np.bincount(swap, weights=sign * w[changed], minlength=len(swaps))
        g += np.bincount(changed, weights=sign * push[swap], minlength=len(g))
        g[-2] = 0
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(size, np.float32)
    out[used] = w[:-2]
    return out, float(w[-1])


def score_texts(texts: Sequence[str], weights: np.ndarray, intercept: float) -> np.ndarray:
    text, bucket = features(texts)
    z = np.bincount(text, weights=weights[bucket], minlength=len(texts)) + intercept
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_SWAPS = pa.list_(pa.struct([("gone", pa.list_(pa.int64())), ("new", pa.list_(pa.int64()))]))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, limit=PIECE_BYTES):
        texts = [t or "" for t in piece.column("text").to_pylist()]
        text, bucket = features(texts)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        data = bucket.astype("<i4").tobytes()
        swaps = [[{"gone": gone.tolist(), "new": new.tolist()} for gone, new in own] for own in counterfactuals(texts)]
        yield pa.record_batch(
            [
                piece.column("doc_id"), piece.column("toxic"),
                pa.array([data[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                pa.array(swaps, _SWAPS),
            ],
            ["doc_id", "toxic", "buckets", "swaps"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """The model for ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; None without both labels."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    # each task keeps its smallest by hash of each label
    first = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = first[0].unionByName(first[1])
    # at most 2 * sample rows, of which each holds the features of one document and of its swaps
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .mapInArrow(_feature_rows, "doc_id long, toxic int, buckets binary, swaps array<struct<gone: array<long>, new: array<long>>>")
        .collect()
    )
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["buckets"]))
    label = np.array([r["toxic"] for r in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return None
    x = [np.frombuffer(r["buckets"], "<i4") for r in rows]
    text = np.repeat(np.arange(len(x)), [len(v) for v in x])
    swaps = pooled((np.array(s["gone"], np.int64), np.array(s["new"], np.int64)) for r in rows for s in r["swaps"])
    return train(text, np.concatenate(x).astype(np.int64), label, swaps)


def scored(
    batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, float] | None
) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows in small pieces, each with the scores of its texts."""
    for piece in pieces(batches, limit=PIECE_BYTES):
        texts = [t or "" for t in piece.column("text").to_pylist()]
        yield piece, score_texts(texts, *model) if model else np.zeros(len(texts))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` → ``(doc_id, score, predicted)``, a row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, scores in scored(batches, shared.value):
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without rows that score ``threshold`` or more."""
    model = fit(learnable(docs), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, scores in scored(batches, shared.value):
            yield piece.filter(pa.array(scores < threshold)) if shared.value else piece

    return docs.mapInArrow(run, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    """Documents of the two folds of three that labels are learned from."""
    return docs.where(fold("doc_id", 3) != 1)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn on two folds of three, score all; ``held_out`` tells the rest (a null id is held out)."""
    out = score(docs, fit(learnable(docs), labels))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")
