"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words are counted by Spark. A word's letter counts are a vector; one replaced code point moves it by a squared
distance of at most 2, an inserted or deleted one by exactly 1, and the length by at most one. So only words of
equal or adjacent length are compared, block by block: NumPy's product of two blocks of counts gives all their
squared distances, pairs at most two apart are kept, and the edit itself is verified.

To keep blocks apart that can't hold such a pair, letters fall into ``GROUPS`` groups, and a word's signature is
how many letters it has of each. An edit moves at most one letter from one group to another, adds or takes one.
Words are range-partitioned by length and signature into blocks of at most ``BLOCK`` words or ``BLOCK_LETTERS``
letters; two blocks are joined only if the boxes around their signatures are near enough, and within the two,
products are made only of runs of words whose signatures are. All the pairs of two blocks are one row's work,
which Spark deals out; no task holds more than two blocks.

Null texts have no words, an empty table gives no rows, and rows without an id count with the id written as
an empty text. Equal rows count as often as they are there. Words of any length are compared whole. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from runscope.llm.tables import written

#: Fixed values of the task: the runs that are words, one in how many loses a letter, and what counts as a word and a form.
RUN = "[A-Za-zÀ-ÿ]"
ONE_IN, LEAST_LETTERS, LEAST_COUNT, TIMES = 31, 7, 2, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letter groups of a signature, and what a block holds at most.
GROUPS, BLOCK, BLOCK_LETTERS = 6, 8192, 1 << 18
#: Pairs of blocks in a task once there are many; distances looked at in one product.
TASK_PAIRS = 32
PRODUCT = 1 << 22


def word_counts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → ``(word, n)``: the words that the task knows, and how often they are there."""
    # shorter runs can't become words
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{LEAST_LETTERS},}}"), F.lit(0)))
    found = docs.select("doc_id", runs.alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    found = found.select("doc_id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    found = found.withColumn("h", F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"), "UTF-8")))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = found.select(F.when(F.col("h") % ONE_IN == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words, and the length of each word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


def signatures(words: list[str]) -> np.ndarray:
    """How many code points of each group a word has."""
    points, size = code_points(words)
    word = np.repeat(np.arange(len(words)), size)
    return np.bincount(word * GROUPS + points % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            words = batch.column("word").to_pylist()
            sign = signatures(words)
            text = ["".join(f"{v:06x}" for v in row) for row in sign.tolist()]  # sorts as the numbers do
            yield pa.record_batch([batch.column("word"), pa.array(sign.sum(axis=1).astype(np.int32)), pa.array(text)], ["word", "letters", "signature"])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words ordered by length and signature → blocks with the box around their signatures."""
    part, number = TaskContext.get().partitionId(), 0
    held: list[str] = []

    def out() -> pa.RecordBatch:
        nonlocal number
        number += 1
        sign = signatures(held)
        return pa.record_batch(
            [
                pa.array([(part << 32) + number]), pa.array([len(held[0])], pa.int32()), pa.array([held], pa.list_(pa.string())),
                pa.array([sign.min(axis=0).tolist()], pa.list_(pa.int32())), pa.array([sign.max(axis=0).tolist()], pa.list_(pa.int32())),
            ],
            ["block", "letters", "words", "low", "high"],
        )

    for batch in batches:
        for word in batch.column("word").to_pylist():
            if held and (len(word) != len(held[0]) or len(held) >= BLOCK or len(held) * len(word) >= BLOCK_LETTERS):
                yield out()
                held = []
            held.append(word)
    if held:
        yield out()


def _steps(grown: bool) -> np.ndarray:
    """How an edit moves a signature: one letter more (``grown``), or the same number."""
    unit = np.eye(GROUPS, dtype=np.int64)
    if grown:
        return unit
    return np.array([np.zeros(GROUPS, np.int64), *(unit[i] - unit[j] for i, j in permutations(range(GROUPS), 2))])


class Block:
    """Words of one length: code points, letter counts, and runs of words with the same signature."""

    def __init__(self, words: list[str]) -> None:
        points, size = code_points(words)
        self.points = points.reshape(len(words), -1)
        sign = signatures(words)
        first = np.flatnonzero(np.append(True, (sign[1:] != sign[:-1]).any(axis=1)))
        stop = np.append(first[1:], len(words))
        self.runs: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for a, b in zip(first.tolist(), stop.tolist(), strict=True):
            self.runs.setdefault(tuple(sign[a].tolist()), []).append((a, b))

    def counts(self, letters: np.ndarray) -> np.ndarray:
        """Letter counts over an alphabet that holds all of the block's letters."""
        place = np.searchsorted(letters, self.points)
        rows = np.arange(len(place))[:, None]
        made = np.bincount((rows * len(letters) + place).ravel(), minlength=len(place) * len(letters))
        kind = np.float32 if self.points.shape[1] < 2048 else np.float64  # squares stay exact
        return made.reshape(len(place), -1).astype(kind)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of code points differ by exactly one edit; ``b`` is as long, or one longer."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= n


def near_words(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two blocks that are one edit apart; of a block with itself (``same``) each pair once."""
    letters = np.unique(np.concatenate([np.unique(a.points), np.unique(b.points)]))
    x = a.counts(letters)
    y = x if same else b.counts(letters)
    x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
    left, right = [], []
    for sign, runs in a.runs.items():
        for step in _steps(b.points.shape[1] > a.points.shape[1]):
            for begin, stop in b.runs.get(tuple((np.array(sign) + step).tolist()), ()):
                for first, last in runs:
                    if same and stop <= first:
                        continue
                    rows = max(1, PRODUCT // (stop - begin))
                    for top in range(first, last, rows):
                        end = min(last, top + rows)
                        apart = x2[top:end, None] + y2[None, begin:stop] - 2 * (x[top:end] @ y[begin:stop].T)
                        i, j = np.nonzero(apart <= 2)
                        i, j = i + top, j + begin
                        if same:
                            i, j = i[i < j], j[i < j]
                        fits = _one_edit(a.points[i], b.points[j])
                        left.append(i[fits])
                        right.append(j[fits])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            first, second = one.column("a")[0].as_py(), one.column("b")[0].as_py()
            words, other = one.column("words").flatten(), one.column("other").flatten()
            a = Block(words.to_pylist())
            i, j = near_words(a, a if first == second else Block(other.to_pylist()), first == second)
            for begin in range(0, len(i), 50_000):
                part = slice(begin, begin + 50_000)
                yield pa.record_batch([words.take(pa.array(i[part])), other.take(pa.array(j[part]))], ["a", "b"])


def _near_boxes() -> F.Column:
    """Whether an edit can lead from a block's signatures into the other's: at most two letters change groups."""
    zero = F.lit(0)
    gaps = F.zip_with("low", "other_high", lambda x, y: F.greatest(x - y, zero)), F.zip_with("other_low", "high", lambda x, y: F.greatest(x - y, zero))
    total = [F.aggregate(g, zero, lambda t, x: t + x) for g in gaps]
    return (total[0] <= 1) & (total[1] <= 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """``words(word)``, each once → ``(a, b)``: pairs exactly one edit apart, each once."""
    signed = words.select("word").mapInArrow(_signed, "word string, letters int, signature string")
    ordered = signed.repartitionByRange("letters", "signature", "word").sortWithinPartitions("letters", "signature", "word")
    blocks = written(ordered.mapInArrow(_blocked, "block long, letters int, words array<string>, low array<int>, high array<int>"), "word-blocks")
    # boxes alone; a length's blocks meet those of its own and of the next
    boxes = blocks.select("block", "letters", "low", "high")
    others = boxes.select(
        F.col("block").alias("b"), F.col("low").alias("other_low"), F.col("high").alias("other_high"),
        F.col("letters").alias("other_letters"), F.explode(F.array(F.col("letters"), F.col("letters") - 1)).alias("letters"),
    )
    pairs = boxes.withColumnRenamed("block", "a").join(others, "letters").where(((F.col("letters") < F.col("other_letters")) | (F.col("a") <= F.col("b"))) & _near_boxes())
    pairs = written(pairs.select("a", "b"), "block-pairs")
    first = blocks.select(F.col("block").alias("a"), "words")
    second = blocks.select(F.col("block").alias("b"), F.col("words").alias("other"))
    both = pairs.join(first, "a").join(second, "b")
    # one pair is much work, so a task gets few
    count = pairs.count()
    return both.repartition(max(1, min(count, 256), count // TASK_PAIRS), F.xxhash64("a", "b")).mapInArrow(_compared, "a string, b string")


def roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` → ``(word, root)``: the end of each chain of forms.

    A form has ``TIMES`` times the count, so chains are short and without cycles; each round doubles
    what a word has followed.
    """
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = known.join(step, "root", "left")
        known = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not known.where("moved").limit(1).count():
            return known.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → ``(word, form, root, n, n_near, form_n)``, a row per word."""
    words = written(word_counts(docs), "words")
    near = written(near_pairs(words), "near-words")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    out = words.join(best, "word", "left").withColumn("is_form", F.coalesce(form_n >= TIMES * F.col("n"), F.lit(False)))
    out = written(
        out.select("word", F.when(F.col("is_form"), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), form_n).alias("form_n")),
        "forms",
    )
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
