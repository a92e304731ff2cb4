"""Quality rules on repeated substrings, found with a suffix array per text.

The symbols are words. A suffix array of all texts of a piece (suffixes end with their text, and
are sorted by text first) comes from prefix doubling, in which only suffixes that still tie are
sorted again. The longest common prefix of neighbours gives, for each word, the longest substring
from there that occurs again in the text: these are the occurrences of the maximal repeated
substrings, the intervals of the LCP array. The union of the long ones is what repetition covers.

Null texts count as empty. Texts without words have all counts 0 and fail the base rules. Long
texts are whole; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runscope.llm.common import Words, per_text_sum, pieces, spread, text_column, words_of

#: Repeated substrings of fewer words than this are ordinary prose.
MIN_REPEAT_WORDS = 6
#: A text is dropped if such repeats cover more of its word characters, in percent …
MAX_COVERED_PERCENT = 50
#: … or if one of them is longer than this, in percent of the text's words, and than LONGEST_FREE words.
MAX_LONGEST_PERCENT = 30
LONGEST_FREE = 50
#: The base rules: at least so many words, at most so many percent in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORD_CHAR = re.compile(r"[^ \t-\r]")


@dataclass
class Repeats:
    """For each word the length of the longest substring from there that occurs again (0 or ≥ 2)."""

    length: np.ndarray


def longest_repeats(words: Words) -> Repeats:
    """The suffix array of each text, and the longest repeat that begins at each word."""
    n = len(words.begin)
    text, code = words.text, words.code
    length = np.zeros(n, np.int64)
    if not n:
        return Repeats(length)
    stop = words.first[1:][text]  # where each word's text ends
    first = text * (int(code.max()) + 1) + code
    suffixes = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    slots = np.arange(n)

    def regroup(slots: np.ndarray, who: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rank sorted suffixes by where their group of equals begins; slots that still tie."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(keys)))
        rank[who] = np.repeat(slots[begin], size)
        return slots[np.repeat(size > 1, size)]

    slots = regroup(slots, suffixes, first[suffixes])
    levels, step = [rank.astype(np.int32)], 1
    while len(slots):
        who = suffixes[slots]
        beyond = who + step
        next_rank = np.where(beyond < stop[who], rank[np.minimum(beyond, n - 1)] + 1, 0)
        keys = rank[who] * (n + 1) + next_rank
        order = np.argsort(keys, kind="stable")
        who = who[order]
        suffixes[slots] = who
        slots = regroup(slots, who, keys[order])
        step *= 2
        if len(slots):
            levels.append(rank.astype(np.int32))
    if len(levels) < 2:
        return Repeats(length)
    # neighbours that share two words or more; the levels are tried from the longest down
    left, right = suffixes[:-1], suffixes[1:]
    close = levels[1][left] == levels[1][right]
    left, right = left[close], right[close]
    common = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < stop[left]) & (b < stop[right])
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        common += np.where(inside & (levels[level][a] == levels[level][b]), 1 << level, 0)
    np.maximum.at(length, left, common)
    np.maximum.at(length, right, common)
    return Repeats(length)


def _duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if _WORD_CHAR.search(line)]
    return len(lines) - len(set(lines))


def repetition_rules(
    docs: DataFrame,
    min_repeat_words: int = MIN_REPEAT_WORDS,
    max_covered_percent: int = MAX_COVERED_PERCENT,
    max_longest_percent: int = MAX_LONGEST_PERCENT,
    longest_free: int = LONGEST_FREE,
) -> DataFrame:
    """``docs(doc_id, text)`` → the base counts, what repeats cover, and the verdict, per row.

    ``covered_chars``: characters of words in repeated substrings of at least
    ``min_repeat_words`` words (at least 2). ``longest_repeat``: words of the longest repeated
    substring, 0 if it is a single word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = text_column(piece)
            words = words_of(texts)
            n_words = words.per_text
            total = np.zeros(len(words.data) + 1, np.int64)
            np.cumsum((words.data & 0xC0) != 0x80, out=total[1:])
            chars = total[words.end] - total[words.begin]
            n_symbols = per_text_sum(_SYMBOL[words.data], words.offsets)
            length = longest_repeats(words).length
            n = len(length)
            at = np.flatnonzero(length >= WINDOW)
            n_repeat = per_text_sum(spread(at, at + WINDOW, n), words.first)
            at = np.flatnonzero(length >= max(2, min_repeat_words))
            covered = per_text_sum(chars * spread(at, at + length[at], n), words.first)
            longest = np.zeros(len(n_words), np.int64)
            np.maximum.at(longest, words.text, length)
            word_chars = per_text_sum(chars, words.first)
            failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
            repeats = (100 * covered > max_covered_percent * word_chars) | (
                (longest > longest_free) & (100 * longest > max_longest_percent * n_words)
            )
            yield pa.record_batch(
                [
                    piece.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(word_chars), pa.array(n_symbols),
                    pa.array(list(map(_duplicate_lines, texts.to_pylist())), pa.int64()), pa.array(n_repeat),
                    pa.array(failed), pa.array(~(failed | repeats)), pa.array(covered), pa.array(longest),
                ],
                COLUMNS,
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


COLUMNS = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    "covered_chars", "longest_repeat",
]
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, covered_chars long, longest_repeat long"
)
