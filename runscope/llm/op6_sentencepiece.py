"""SentencePiece BPE by a table of the last token of each prefix.

Merges never cross the border between a text character and the space mark, nor a character that
no longer piece holds, so a text is cut there and each distinct part is encoded once per task.
Within a part, the encoding of a prefix has one possible last token. A candidate is a piece that
an automaton finds ending at the prefix's end, and it is the last token exactly if it can stand
behind the last token of what comes before it, that is if the library's merges would leave that
pair of tokens unmerged. So the table is filled from left to right with one number per position,
and the ids are read from right to left.

Null texts count as empty. An empty text has the end id only. Rows are independent: repeated rows
give repeated results, and further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runscope.llm.common import pieces

#: The mark that stands for a space in pieces (fixed by the format).
SPACE = "▁"
#: Encoded parts that a worker keeps; it starts anew beyond that.
KEPT_PARTS = 100_000
#: Characters behind several spaces that are merged by definition.
KEPT_LENGTH = 64
#: Pairs of tokens whose compatibility a worker keeps.
KEPT_PAIRS = 300_000
#: Bytes of text that are encoded at a time. Few, as a worker keeps the memory of its largest piece for all later tasks.
PIECE_BYTES = 512 << 10


class PrefixTableBpe:
    """Encoder and decoder for a model file of the BPE kind with byte fallback.

    The model must escape spaces, add one in front, keep repeated spaces and have no
    normalisation rules; anything else is refused.
    """

    def __init__(self, model: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        probe = "A  ﬁ é  x "
        if sp.decode(sp.encode(probe)) != probe or sp.id_to_piece(sp.encode("a b"))[0][0] != SPACE:
            raise ValueError("only models without normalisation, with a leading space, are supported")
        self.end = sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.control = set()
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i):
                self.control.add(i)
            else:
                self.id[piece], self.score[piece] = i, sp.get_score(i)
        self.byte_of = {i: b for b, i in self.byte.items()}
        longer = [p for p in self.id if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece goes on after a space mark")
        #: What stands at a piece's start and end while its own merges go on.
        self.starts: dict[str, list[str]] = {}
        self.ends: dict[str, list[str]] = {}
        #: Pieces that their own merges lead to; no other piece can be a token.
        self.automaton = ahocorasick.Automaton()
        for piece in longer:
            starts, ends = [piece[0]], [piece[-1]]
            if self.merged(piece, starts, ends) == [piece]:
                self.automaton.add_word(piece, self.id[piece])
                self.starts[piece], self.ends[piece] = starts, ends
        self.automaton.make_automaton()
        #: Characters of each piece; 1 behind the last, for characters without one.
        self.size = np.array([*map(len, self.pieces), 1], np.int64)
        # a newline that no longer piece holds is a part; so is what follows a letter nowhere in a piece
        alone = "\n" if not any("\n" in p for p in longer) else ""
        joined = {y for p in longer for x, y in zip(p, p[1:], strict=False) if re.match(r"\w", x)}
        stops = "".join(re.escape(c) for c in ",.!?;:" if c not in joined)
        self.part = re.compile(
            (f"{SPACE}?\\w++(?=[{stops}])|" if stops else "")
            + f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + ("|\n" if alone else "")
        )
        #: Whether a token, by number, can stand behind another: filled as pairs come up.
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        #: What each id stands for, as decimal text and as bytes of decoded text.
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.decoded = [
            bytes((self.byte_of[i],)) if i in self.byte_of
            else b"" if i in self.control
            else piece.replace(SPACE, " ").encode()
            for i, piece in enumerate(self.pieces)
        ]

    def _fits(self, a: str, b: str) -> bool:
        """Whether the tokens ``a`` and ``b`` stay as they are side by side.

        They do if nothing that ever stands at the end of ``a`` can merge with what stands at the
        start of ``b``. If both as a whole could merge, they don't. Else the merges decide.
        """
        score = self.score
        if a + b in score:
            return False
        starts = self.starts.get(b, (b,))
        if not any(x + y in score for x in self.ends.get(a, (a,)) for y in starts):
            return True
        return self.merged(a + b) == [a, b]

    def merged(self, text: str, starts: list[str] | None = None, ends: list[str] | None = None) -> list[str]:
        """Tokens by the definition: merge the best pair, the leftmost among equals, until none is left.

        Used on single pieces and on pairs of pieces to fill the tables, and on runs of spaces.
        ``starts`` and ``ends`` get each token that a merge puts at the text's start or end.
        """
        tokens: list[str | None] = list(text)
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(text):
                both = tokens[i] + tokens[j]
                if both in self.score:
                    heapq.heappush(queue, (-self.score[both], i, j, both))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if tokens[i] is None or tokens[j] is None or right[i] != j or tokens[i] + tokens[j] != both:
                continue
            tokens[i], tokens[j] = both, None
            right[i] = right[j]
            if starts is not None and i == 0:
                starts.append(both)
            if ends is not None and right[i] == len(text):
                ends.append(both)
            if right[i] < len(text):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [t for t in tokens if t is not None]

    def _number(self, char: str) -> int:
        """A character's piece, or a number past all pieces."""
        return self.id.get(char, len(self.pieces) + ord(char))

    def _name(self, number: int) -> str:
        return self.pieces[number] if number < len(self.pieces) else chr(number - len(self.pieces))

    def _can_follow(self, a: int, b: int) -> bool:
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        fits = self.pairs[a << 32 | b] = self._fits(self._name(a), self._name(b))
        return fits

    def _fitting(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token can stand behind the one before it; each distinct pair is looked up once."""
        pairs, where = np.unique(before << 32 | token, return_inverse=True)
        known = self.pairs
        fits = [known.get(k) for k in pairs.tolist()]
        for i, fit in enumerate(fits):
            if fit is None:
                fits[i] = self._can_follow(int(pairs[i]) >> 32, int(pairs[i]) & 0xFFFFFFFF)
        return np.array(fits, bool)[where]

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of each part (none empty), as 32-bit numbers, by the prefix table, for all parts together.

        The table has a cell per character, and is filled by place in the part: all first
        characters, then all second ones, and so on; a long part only has more places.
        """
        if not parts:
            return []
        text = "".join(parts)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        stop = np.cumsum(size)
        start = stop - size
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        distinct, where = np.unique(chars, return_inverse=True)
        last = np.array([self._number(chr(c)) for c in distinct.tolist()], np.int64)[where]
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, token = found[:, 0], found[:, 1]
        begin = end + 1 - self.size[token]
        part = np.searchsorted(stop, end, "right")
        inside = begin >= start[part]
        end, token, begin, place = end[inside], token[inside], begin[inside], (end - start[part])[inside]
        whole = place + 1 == self.size[token]
        order = np.argsort(place, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []:
            fits = whole[group]
            rest = group[~fits]
            if len(rest):
                fits = fits.copy()
                fits[~fits] = self._fitting(last[begin[rest] - 1], token[rest])
            hit = group[fits]
            last[end[hit]] = token[hit]
        # from the last token of each part back to the first
        is_token = np.zeros(len(last), bool)
        at, first = stop - 1, start
        while len(at):
            is_token[at] = True
            at = at - self.size[np.minimum(last[at], len(self.pieces))]
            on = at >= first
            at, first = at[on], first[on]
        ends = np.cumsum(is_token)[stop - 1]
        return self._spelled(last[is_token], ends)

    def _spelled(self, tokens: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of the tokens up to each end, as 32-bit numbers; characters without a piece become bytes."""
        odd = np.flatnonzero(tokens >= len(self.pieces))
        if len(odd):
            spelled = [[self.byte[b] for b in self._name(t).encode()] for t in tokens[odd].tolist()]
            size = np.ones(len(tokens), np.int64)
            size[odd] = [len(x) for x in spelled]
            total = np.cumsum(size)
            out = np.repeat(tokens, size)
            for x, end in zip(spelled, total[odd].tolist(), strict=True):
                out[end - len(x) : end] = x
            tokens, ends = out, total[ends - 1]
        data = tokens.astype("<i4").tobytes()
        cuts = (ends * 4).tolist()
        return [data[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _after_spaces(self, part: str) -> bytes:
        """A part that begins with several spaces; pieces of spaces share one score, so order decides.

        Only the spaces and the first token behind them depend on each other, so no more than the
        spaces and a bounded stretch behind them is merged by definition.
        """
        spaces = len(part) - len(part.lstrip(SPACE))
        rest = b""
        names = part
        if len(part) > spaces + KEPT_LENGTH:
            rest = self.ids_of([part[spaces - 1 :]])[0]
            alone = int.from_bytes(rest[:4], "little") == self.id[SPACE]
            names, rest = SPACE * (spaces if alone else spaces - 1), rest[4:] if alone else rest
        numbers = np.array([self._number(t) if len(t) == 1 else self.id[t] for t in self.merged(names)], np.int64)
        return self._spelled(numbers, np.array([len(numbers)]))[0] + rest

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, the end id last."""
        cut = [self.part.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > KEPT_PARTS:
            self.known.clear()
        known = self.known
        new = set()
        for parts in cut:
            new.update(parts)
        new -= known.keys()
        spaced = [p for p in new if p.startswith(SPACE * 2)]
        plain = list(new.difference(spaced))
        known.update(zip(plain, self.ids_of(plain), strict=True))
        known.update((p, self._after_spaces(p)) for p in spaced)
        end = np.array([self.end], "<i4").tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, parts)) + end, "<i4").tolist() for parts in cut]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, bytes read as UTF-8, the space in front dropped."""
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def encoder(model: str) -> PrefixTableBpe:
    """One encoder per worker process and model."""
    return PrefixTableBpe(model)


def encode_column(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded)`` for each row; the general form, with the real ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model)
        for piece in pieces(batches, text_col, PIECE_BYTES):
            ids = bpe.encode([t or "" for t in piece.column(text_col).to_pylist()])
            yield pa.record_batch(
                [piece.column(id_col), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())],
                [id_col, "ids", "decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digest_rows(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    bpe = encoder(model)
    for piece in pieces(batches, limit=PIECE_BYTES):
        rows = []
        for ids in bpe.encode([t or "" for t in piece.column("text").to_pylist()]):
            rows.append(
                (
                    len(ids),
                    hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest(),
                    hashlib.sha256(bpe.decode(ids).encode()).hexdigest(),
                )
            )
        n, ids_hex, text_hex = zip(*rows, strict=True)
        yield pa.record_batch(
            [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(text_hex)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def token_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document the number of ids and digests of the ids and of the decoded text.

    The same encoder and decoder as :func:`encode_column`, without shipping ids out of the task.
    """
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: digest_rows(batches, model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
