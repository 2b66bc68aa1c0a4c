"""Vector best-fit packing of tokenised documents into sequences of bounded size.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are placed in decreasing length; among the open sequences that can take a piece
under every capacity, the one with the best score is chosen: the largest weighted dot product of
piece and residual, or the smallest weighted norm of what would remain.

Pieces are dealt evenly into groups of bounded size by their position in the stored piece table,
and each group is packed by one task, so neither a task nor the driver holds all of them; a group
leaves at most a few sequences partly filled.

Defined results: a null text is an empty text, which is one token (id 0); only documents longer
than a sequence are cut; repeated rows are packed as often as they occur; an empty table gives
no sequences.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lossledger.llm.common import map_rows, staged

CAPACITY = 2048
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
GROUP_ROWS = 150_000
CACHE_WORDS = 200_000  # words in each of the two generations a Python worker keeps
CACHE_STEMS = 200_000  # words without marks


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordTokens:
    """Token ids of a text, word by word, as packed little-endian 32-bit numbers.

    The vocabulary drops white space and never merges across it, so a text's ids are its words'
    ids in a row. Recently used words are kept in two generations of bounded size.
    """

    def __init__(self, path: str = TOKENIZER):
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, stem: str) -> bytes:
        found = self.stems.get(stem)
        if found is None:
            plain = "".join([self.letters[b] for b in stem.encode()])
            found = np.array([t.id for t in self.tokenizer.model.tokenize(plain)], "<u4").tobytes()
            if len(self.stems) >= CACHE_STEMS:
                self.stems.clear()
            self.stems[stem] = found
        return found

    def _word(self, word: bytes) -> bytes:
        """Letters and the marks behind them are separate pieces of the vocabulary's own splitting.

        Only Latin letters go this way; their composed forms and lower case are plain.
        """
        text = word.decode()
        stem = text.rstrip(".,!?;:$%&*#|)")
        latin = stem.isascii() or (max(stem) < "ɐ" and unicodedata.is_normalized("NFC", stem)) if stem else False
        if latin and stem.isalpha() and stem.lower().isalpha():
            rest = text[len(stem):]
            head = self._stem(stem.lower())
            return head + self._mark(rest) if rest else head
        return self._encode(text)

    def _mark(self, marks: str) -> bytes:
        key = "\0" + marks
        found = self.stems.get(key)
        if found is None:
            found = self.stems[key] = self._encode(marks)
        return found

    def _missing(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self._word(word)
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        get = self.young.get
        words = text.encode().split()
        packed = list(map(get, words))
        if None in packed:
            packed = [self._missing(w) if p is None else p for w, p in zip(words, packed)]
        return b"".join(packed)


_LOADED: dict[str, WordTokens] = {}


def loaded(path: str) -> WordTokens:
    """One tokenizer for each Python worker and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 tokenizer_path: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    schema = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint"}
    if with_ids:
        schema["ids"] = "array<int>"

    def cut(rows: Iterator[dict]) -> Iterator[tuple]:
        tokens = loaded(tokenizer_path)
        for row in rows:
            packed = tokens.ids(row["text"]) + b"\0\0\0\0"
            for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                part = packed[at : at + 4 * capacity]
                out = row["doc_id"], piece, at // 4, len(part) // 4, zlib.crc32(part)
                yield (*out, np.frombuffer(part, "<u4").tolist()) if with_ids else out

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(slim, schema, cut)


class VectorBins:
    """Open sequences by their whole residual vector; those with equal residuals wait in a heap, first opened first."""

    def __init__(self, capacity: int, documents: int, cost: int, weights: tuple[float, float, float], score: str):
        if score not in ("norm", "dot"):
            raise ValueError("score is norm or dot")
        self.full = np.array([capacity, documents, cost], float)
        self.scale = np.asarray(weights, float) / self.full
        self.score = score
        self.rooms = np.full((3, 1024), -1.0)  # a column for each residual vector, -1 where there is none
        self.waiting: list[list[int]] = []  # sequences of each column
        self.column: dict[tuple[float, float, float], int] = {}
        self.free: list[int] = []
        self.count = 0

    def _open(self, room: tuple[float, float, float], number: int) -> None:
        at = self.column.get(room)
        if at is None:
            if self.free:
                at = heapq.heappop(self.free)
            else:
                at = len(self.waiting)
                self.waiting.append([])
                if at == self.rooms.shape[1]:
                    self.rooms = np.hstack([self.rooms, np.full_like(self.rooms, -1.0)])
            self.column[room] = at
            self.rooms[:, at] = room
        heapq.heappush(self.waiting[at], number)

    def _take(self, at: int) -> tuple[tuple[float, float, float], int]:
        room = tuple(self.rooms[:, at].tolist())
        number = heapq.heappop(self.waiting[at])
        if not self.waiting[at]:
            del self.column[room]
            self.rooms[:, at] = -1.0
            heapq.heappush(self.free, at)
        return room, number

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece of ``length`` tokens."""
        need = np.array([length, 1, length * length], float)
        if (need > self.full).any():
            raise ValueError("a piece is larger than an empty sequence")
        tokens, documents, cost = self.rooms[:, : len(self.waiting)]
        fits = np.flatnonzero((tokens >= length) & (documents >= 1) & (cost >= need[2]))
        if len(fits):
            left = self.rooms[:, fits]
            if self.score == "norm":
                pick = np.argmin((((left - need[:, None]) * self.scale[:, None]) ** 2).sum(axis=0))
            else:
                pick = np.argmax(((need * self.scale**2)[:, None] * left).sum(axis=0))
            room, number = self._take(int(fits[pick]))
        else:
            room, number = tuple(self.full.tolist()), self.count
            self.count += 1
        rest = (room[0] - length, room[1] - 1, room[2] - length * length)
        if min(rest) > 0:
            self._open(rest, number)
        return number, int(self.full[0] - room[0])


def best_fit(lengths: np.ndarray, capacity: int, documents: int, cost: int,
             weights: tuple[float, float, float], score: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, longest pieces first."""
    bins = VectorBins(capacity, documents, cost, weights, score)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        sequence[i], offset[i] = bins.place(int(lengths[i]))
    return sequence, offset


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, max_documents: int | None = None,
         max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
         score: str = "norm", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (with a column ``length``) with ``sequence_id`` and ``offset``.

    ``max_documents`` and ``max_cost`` default to what a sequence of ``capacity`` tokens can hold
    at all, so that tokens alone bind.
    """
    documents = max_documents or capacity
    cost = max_cost or capacity * capacity
    rows = staged(pieces)
    groups = max(1, -(-rows.count() // group_rows))
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def fill(frame):
        number = int(frame["_group"].iloc[0])
        sequence, offset = best_fit(frame["length"].to_numpy(), capacity, documents, cost, weights, score)
        frame["sequence_id"] = sequence + (number << 32)
        frame["offset"] = offset
        return frame.drop(columns="_group")

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return dealt.groupBy("_group").applyInPandas(fill, f"{fields}, sequence_id bigint, offset bigint")
