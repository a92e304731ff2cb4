"""Benchmark decontamination by spaced seeds.

A seed is a window of ``SPAN`` words of which a mask selects some; the others may be anything, so a
few substituted words don't hide a passage. The hashes of all windows of all documents, under each mask, are
joined with those of the benchmark. Hits of a document and an item with the same distance between their
places lie on one diagonal. On each, the two texts are compared once, word by word, as far as both
reach: a match counts ``MATCH``, a substitution ``-MISS``, and the best run of words must reach ``MIN_SCORE``,
or ``ITEM_PERCENT`` percent of what the whole item would score. Items with fewer than ``SPAN`` words have one
seed of all their words, so they are found where a document holds them word by word.

Words are runs of letters and digits, lower-cased. All of it is built-in functions on rows of
``documents``: windows are numbered by a sequence, hashes are picked from the document's array of
word hashes, and only verified hits are shuffled. Nulls count as empty. Texts and items without a word
give no row, nor do documents or items without an id. Repeated rows give the
same pairs once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from runscope.llm.tables import measured, without

#: Positions that count, in windows of SPAN words.
SPAN = 12
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 7, 9, 10, 11), (0, 1, 3, 4, 6, 8, 10, 11), (0, 2, 3, 5, 6, 7, 9, 11))
MATCH, MISS, MIN_SCORE = 2, 3, 24
#: Share, in percent, of the score of a whole item that is enough where that is below MIN_SCORE.
ITEM_PERCENT = 80


def word_hashes(text: str) -> Column:
    """64-bit hashes of the words of a column, in order; that of the empty string alone if there is no word."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.transform(F.split(plain, " "), lambda w: F.xxhash64(w))


def _hashed(texts: DataFrame) -> DataFrame:
    """``texts(doc_id, text)`` → ``(doc_id, words, row)``."""
    return texts.select("doc_id", word_hashes("text").alias("words")).withColumn("row", F.xxhash64("words"))


#: A seed's shape: how many words it spans, and which of them count.
Shape = tuple[int, tuple[int, ...]]


def shapes(items: DataFrame, masks: Sequence[Sequence[int]] = MASKS, span: int = SPAN) -> list[Shape]:
    """The masks, and one shape of all words for each length below ``span`` that an item has."""
    short = items.where(F.size("words") < span).select(F.size("words").alias("n")).distinct().orderBy("n").collect()  # below span rows
    return [(span, tuple(mask)) for mask in masks] + [(r["n"], tuple(range(r["n"]))) for r in short]


def _seed(hashes: Column, at: Column, shape: Shape) -> Column:
    return F.xxhash64(F.lit(",".join(map(str, shape))), *[F.get(hashes, at + k) for k in shape[1]])


def seeds(texts: DataFrame, every: Sequence[Shape]) -> DataFrame:
    """``texts(…, words)`` → a row per window and shape, with ``at`` and ``seed`` added; null where it doesn't fit."""
    least, size = min(n for n, _ in every), F.size("words")
    windows = texts.where(size >= least).withColumn("at", F.explode(F.sequence(F.lit(0), size - least)))
    at = F.col("at")
    of_shape = [
        _seed(F.col("words"), at, shape) if shape[0] == least else F.when(at + shape[0] <= size, _seed(F.col("words"), at, shape))
        for shape in every
    ]
    return windows.withColumn("seed", F.explode(F.array(*of_shape)))


def item_seeds(items: DataFrame, every: Sequence[Shape], span: int) -> DataFrame:
    """The seeds of items: under the masks, or of all words of an item that is shorter than they span."""
    long = [shape for shape in every if shape[0] == span]
    own = seeds(items.where(F.size("words") >= span), long)
    for shape in every:
        if shape[0] < span:
            own = own.unionByName(seeds(items.where(F.size("words") == shape[0]), [shape]))
    return own


def _best_run(words: Column, item_words: Column, diagonal: Column) -> Column:
    """The best run of aligned words on a diagonal: its score, and its first and last word in the text."""
    first, item_first = F.greatest(diagonal, F.lit(0)), F.greatest(-diagonal, F.lit(0))
    length = F.least(F.size(words) - first, F.size(item_words) - item_first)
    a = F.slice(words, first + 1, length)
    b = F.slice(item_words, item_first + 1, length)
    equal = F.zip_with(a, b, lambda x, y: x == y)
    zero = F.lit(0)
    start = F.struct(*[zero.alias(n) for n in ("i", "run", "begin", "best", "best_begin", "best_end")])

    def step(s: Column, same: Column) -> Column:
        begin = F.when(s["run"] > 0, s["begin"]).otherwise(s["i"])
        run = F.greatest(s["run"], zero) + F.when(same, F.lit(MATCH)).otherwise(F.lit(-MISS))
        better = run > s["best"]
        return F.struct(
            (s["i"] + 1).alias("i"), run.alias("run"), begin.alias("begin"), F.greatest(run, s["best"]).alias("best"),
            F.when(better, begin).otherwise(s["best_begin"]).alias("best_begin"),
            F.when(better, s["i"] + 1).otherwise(s["best_end"]).alias("best_end"),
        )

    def finish(s: Column) -> Column:
        return F.struct(s["best"].alias("score"), (first + s["best_begin"]).alias("begin"), (first + s["best_end"]).alias("end"))

    return F.aggregate(equal, start, step, finish)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: Sequence[Sequence[int]] = MASKS,
    span: int = SPAN,
    min_score: int = MIN_SCORE,
) -> DataFrame:
    """``(doc_id, item_id, score, begin, end)`` of each document and item that overlap.

    ``score`` is that of the best run; ``begin`` and ``end`` are the first and last of the
    document's words in any run. The benchmark's seeds are broadcast if they
    are small when written, else joined by shuffle.
    """
    items = measured(
        benchmark.where("item_id is not null")
        .select("item_id", word_hashes("text").alias("words"))
        .where(F.get("words", F.lit(0)) != F.xxhash64(F.lit("")))
        .distinct(),
        "items",
    )
    every = shapes(items, masks, span)
    items = items.withColumn("item_row", F.xxhash64("words"))
    known = measured(item_seeds(items, every, span).select("seed", "item_id", "item_row", F.col("at").alias("item_at")).distinct(), "seeds")
    item_words = items.select("item_id", "item_row", F.col("words").alias("item_words"))
    # repeated seeds and masks that hit the same diagonal of a row are one comparison
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    hits = (
        seeds(_hashed(texts), every)
        .join(known, "seed")
        .select("doc_id", "row", "item_id", "item_row", (F.col("at") - F.col("item_at")).alias("diagonal"))
        .distinct()
    )
    hits = measured(hits, "diagonals")
    # words are worked out again of documents with a hit only
    again = _hashed(texts.join(hits.select("doc_id"), "doc_id", "left_semi"))
    best = again.join(hits, ["doc_id", "row"]).join(item_words, ["item_id", "item_row"]).select(
        "doc_id", "item_id", F.size("item_words").alias("n"), _best_run(F.col("words"), F.col("item_words"), F.col("diagonal")).alias("run")
    )
    enough = (F.col("score") >= min_score) | (F.col("score") * 100 >= F.col("n") * MATCH * ITEM_PERCENT)
    found = best.select("doc_id", "item_id", "n", "run.*").where(enough)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.min("begin").alias("begin"), F.max("end").alias("end")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that overlap with the benchmark."""
    return without(docs, overlaps(docs, benchmark).select("doc_id"), "contaminated")
