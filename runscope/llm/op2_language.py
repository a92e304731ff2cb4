"""Language by the nearest of several centroids per language.

A text is a vector of hashed byte 2- and 3-gram counts times inverse document frequency, of length
1. Document frequencies come from all documents that may be learned from; the centroids from a
bounded sample of them (``SAMPLE`` documents per language, the smallest by hash), clustered per
language by cosine. A text gets the language of the centroid with the largest cosine; it is
``rejected`` if it is farther from that centroid than nearly all of the centroid's own documents.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could
be learned from. Texts are whole. Repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from runscope.llm.common import pieces
from runscope.llm.grams import grams, has_letter, letters

#: Buckets of the n-grams, as a power of two.
BITS = 12
#: Documents per language that centroids are fitted on, at most; centroids per language.
SAMPLE, CENTROIDS, ROUNDS = 400, 4, 8
#: A text is rejected below this share of the smallest cosine among a centroid's documents.
REJECT_BELOW = 0.6
UNKNOWN = "und"
#: Texts of a piece; bounds the dense matrix of counts.
PIECE_TEXTS, PIECE_BYTES = 512, 2 << 20


def counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, a row per text."""
    data, offsets = letters(texts)
    out = np.zeros(len(texts) << BITS, np.float32)
    for size in (2, 3):
        text, bucket = grams(data, offsets, size, BITS, in_word=False)
        out += np.bincount(text << BITS | bucket, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), 1 << BITS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1 (0 for texts without any n-gram)."""
    weighted = np.log1p(counts(texts)) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, limit=PIECE_BYTES):
        for begin in range(0, piece.num_rows, PIECE_TEXTS):
            yield piece.slice(begin, PIECE_TEXTS)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents and, per bucket, of documents with one of its n-grams.

    Each task sends one row per bucket, and Spark adds them up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(1 << BITS, np.int64)
        for piece in _bounded(batches):
            found += (counts([t or "" for t in piece.column("text").to_pylist()]) > 0).sum(axis=0)
            total += piece.num_rows
        if total:
            yield pa.record_batch(
                [pa.array(np.append(np.arange(1 << BITS), -1)), pa.array(np.append(found, total))], ["bucket", "n"]
            )

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros((1 << BITS) + 1, np.int64)
    for bucket, n in rows.toLocalIterator():  # a fixed number of rows
        found[bucket] = n
    return int(found[-1]), found[:-1]


def cluster(points: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; centroids, and the smallest cosine to each."""
    seeds = [points.mean(axis=0)]
    for _ in range(1, min(k, len(points))):
        seeds.append(points[np.argmin((points @ np.array(seeds).T).max(axis=1))])
    centroids = np.array(seeds)
    for _ in range(rounds):
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        nearest = (points @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (nearest == c).any():
                centroids[c] = points[nearest == c].mean(axis=0)
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    cosine = points @ centroids.T
    nearest = cosine.argmax(axis=1)
    least = [cosine[nearest == c, c].min(initial=1.0) for c in range(len(centroids))]
    return centroids.astype(np.float32), np.array(least, np.float64)


def fit(learnable: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> dict:
    """The model of ``learnable(doc_id, text, lang)``; rows without a language or text are passed over."""
    learnable = learnable.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    total, found = document_frequencies(learnable)
    idf = (np.log((1 + total) / (1 + found)) + 1).astype(np.float32)
    # the documents with the smallest hash of each language: first those below a bound that about
    # twice the sample is expected to be below, so that no more than that is ranked
    ids = learnable.select("doc_id", "lang", (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5).alias("place"))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    near = ids.join(F.broadcast(sizes), "lang").where(F.col("place") * F.col("n") <= 2 * sample + 50)
    order = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = near.withColumn("nth", order).where(F.col("nth") <= sample)
    chosen = chosen.select("doc_id").distinct()
    texts = learnable.join(F.broadcast(chosen), "doc_id", "left_semi")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"])
        points = np.concatenate(
            [vectors(frame["text"].iloc[i : i + PIECE_TEXTS].tolist(), idf) for i in range(0, len(frame), PIECE_TEXTS)]
        )
        centroids, least = cluster(points, k)
        return pd.DataFrame(
            {"lang": frame["lang"].iloc[0], "nth": range(len(least)), "centroid": [c.tobytes() for c in centroids], "least": least}
        )

    fitted = texts.groupBy("lang").applyInPandas(run, "lang string, nth int, centroid binary, least double")
    rows = sorted(fitted.collect(), key=lambda r: (r["lang"], r["nth"]))  # a few centroids per language
    return {
        "idf": idf,
        "langs": [r["lang"] for r in rows],
        "centroids": np.array([np.frombuffer(r["centroid"], np.float32) for r in rows]).reshape(len(rows), 1 << BITS),
        "least": np.array([r["least"] for r in rows]),
    }


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text)`` → ``(doc_id, lang_pred, score, rejected)``, a row per row.

    ``lang_pred`` is the nearest centroid's language also where ``rejected`` says that it is far.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for piece in _bounded(batches):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            known = np.array([has_letter(t) for t in texts]) & bool(m["langs"])
            lang, score, far = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known.any():
                cosine = vectors(texts, m["idf"]) @ m["centroids"].T
                nearest = cosine.argmax(axis=1)
                best = cosine[np.arange(len(texts)), nearest].astype(float)
                lang[known] = np.array(m["langs"], object)[nearest[known]]
                score[known] = np.clip(best[known], 0, 1)
                far[known] = best[known] < REJECT_BELOW * m["least"][nearest[known]]
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(far)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )


def fold(doc_id: str, folds: int) -> Column:
    """The fold of a document: the CRC-32 of its id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def identify(docs: DataFrame) -> DataFrame:
    """Learn on three folds of four, predict all; ``held_out`` tells the rest (a null id is held out)."""
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(True))
    model = fit(docs.where(~held_out))
    out = predict(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
