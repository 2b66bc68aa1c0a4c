"""Substring dedup: windows of fifty words that an earlier document already has are removed.

First pass: each window is represented by the least hash among its runs of 25 words, which equal
windows share and neighbours mostly share too. Every task counts, in a count-min sketch, in how many
documents each representative occurs; the sketches are merged. A count is never too low, so a window
whose representative is counted once occurs in one document only.

Second pass: neighbouring windows with the same representative, counted more than once, form a
stretch. Stretches are grouped exactly. A stretch that also is in an earlier document goes as a
whole. Where a representative has several different stretches, the first copy of each is read again, taken
apart, and its windows are grouped exactly, by two 64-bit hashes. Every grouping is a minimum with partial
aggregation, so a passage in a third of all documents is one row per task.

Texts are shuffled only where something is to be looked at or removed: which ids that may be is known to
the scans through a bit field of fixed size, which lets some others pass but holds back none.

Defined results: a null text has no words; a document of fewer than fifty words keeps them all; a
null id is never earlier nor later, so its row keeps all words; rows with equal id and text get
equal results and rows with equal id are not earlier than one another; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import Sketch, map_batches, map_rows, merged_sketch, staged
from lossledger.llm.hashing import mix, run_hashes, sliding_min, word_hashes

WINDOW = 50
SKETCH = Sketch(depth=2, bits=25, dtype="u1", top=3)  # 64 MB whatever the corpus
MEMBERS = Sketch(depth=2, bits=24, dtype="u1", top=1)  # 32 MB whatever the number of ids


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but the space and the characters 9 to 13."""
    return text.encode().split() if text else []


class Windows:
    """The windows of one document: their representatives and where stretches begin."""

    def __init__(self, text: str | None, window: int):
        self.window, self.hashes = window, word_hashes(words_of(text))
        self.count = len(self.hashes) - window + 1
        if self.count < 1:
            self.least = self.starts = np.empty(0, np.int64)
            return
        run = max(1, window // 2)
        span = window - run + 1
        self.least = sliding_min(run_hashes(self.hashes, run, 2), span)
        first = np.r_[True, self.least[1:] != self.least[:-1]]
        at = np.arange(self.count)
        since = at - np.maximum.accumulate(np.where(first, at, 0))
        self.starts = np.flatnonzero(since % span == 0)

    def representatives(self) -> np.ndarray:
        return np.unique(self.least[self.starts]) if self.count > 0 else np.empty(0, "u8")


def stretches(docs: DataFrame, cells, sketch: Sketch, window: int) -> DataFrame:
    """Stretches of windows whose representative is estimated to occur in several documents."""

    def find(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            if row["doc_id"] is None:
                continue
            found = Windows(row["text"], window)
            if found.count < 1:
                continue
            keys = found.least[found.starts]
            often = sketch.estimate(cells.value, keys) > 1
            if not often.any():
                continue
            exact = run_hashes(found.hashes, window, 1).view("i8")
            ends = np.r_[found.starts[1:], found.count]
            for key, start, end in zip(keys[often].view("i8").tolist(), found.starts[often].tolist(), ends[often].tolist()):
                own = exact[start:end]
                digest = hashlib.blake2b(own.tobytes(), digest_size=8).digest()
                yield (row["doc_id"], row["text_key"], key, int.from_bytes(digest, "little", signed=True), start,
                       end - start)

    return map_rows(docs, {"doc_id": "bigint", "text_key": "bigint", "gram": "bigint", "stretch": "bigint",
                           "start": "int", "n": "int"}, find)


def _member_keys(ids: list[int | None]) -> np.ndarray:
    return mix(np.array([i for i in ids if i is not None], "i8").view("u8"))


class Members:
    """Which ids may be among those of a table."""

    def __init__(self, table: DataFrame):
        self.cells = table.sparkSession.sparkContext.broadcast(
            merged_sketch(table.select("doc_id"), MEMBERS, lambda row: _member_keys([row["doc_id"]])))

    def mask(self, ids: list[int | None]) -> list[bool]:
        found = iter((MEMBERS.estimate(self.cells.value, _member_keys(ids)) > 0).tolist())
        return [i is not None and next(found) for i in ids]

    def rows(self, docs: DataFrame) -> DataFrame:
        """``docs`` without the rows whose id is not in the table."""
        place = docs.columns.index("doc_id")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(self.mask(batch.column(place).to_pylist()), pa.bool_()))

        return map_batches(docs, keep, docs.schema)


def _taken_apart(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """The windows of the asked stretches (``gram, start, n`` in the array ``parts``), one row each."""

    def windows(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            exact = run_hashes(word_hashes(words_of(row["text"])), window, 1).view("i8").tolist()
            for gram, start, n in zip(row["grams"], row["starts"], row["counts"]):
                for at in range(start, start + n):
                    yield row["doc_id"], row["text_key"], gram, exact[at], at

    met = Members(asked).rows(docs).join(asked.hint("shuffle_hash"), ["doc_id", "text_key"]).select(
        "doc_id", "text_key", "text", F.col("parts.gram").alias("grams"), F.col("parts.start").alias("starts"),
        F.col("parts.n").alias("counts"))
    return map_rows(met, {"doc_id": "bigint", "text_key": "bigint", "gram": "bigint", "window": "bigint", "start": "int"}, windows)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, sketch: Sketch = SKETCH) -> DataFrame:
    """``doc_id, text_key`` and arrays ``starts``, ``counts``: windows that an earlier document has."""
    cells = docs.sparkSession.sparkContext.broadcast(
        merged_sketch(docs.select("text"), sketch, lambda row: Windows(row["text"], window).representatives()))
    found = staged(stretches(docs, cells, sketch, window))
    firsts = staged(found.groupBy("gram", "stretch").agg(F.min("doc_id").alias("first")))
    several = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("gram")
    whole = found.join(firsts, ["gram", "stretch"]).where("doc_id > first").select("doc_id", "text_key", "start", "n")

    # the first copy of each stretch, where other stretches share its representative
    unclear = firsts.join(several, "gram", "left_semi").withColumnRenamed("first", "doc_id")
    asked = staged(found.join(unclear, ["gram", "stretch", "doc_id"], "left_semi").groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("gram", "start", "n")).alias("parts")))
    single = staged(_taken_apart(docs, asked, window))
    earliest = single.groupBy("gram", "window").agg(F.min("doc_id").alias("first"))
    parts = single.join(earliest, ["gram", "window"]).where("doc_id > first").select(
        "doc_id", "text_key", "start", F.lit(1).alias("n"))
    return whole.unionByName(parts).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n")).alias("ranges")).select(
        "doc_id", "text_key", F.col("ranges.start").alias("starts"), F.col("ranges.n").alias("counts"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 with_text: bool = False, sketch: Sketch = SKETCH) -> DataFrame:
    """Per document row: ``doc_id``, words, removed words, digest of the kept ones and, if asked, them."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      F.xxhash64(F.col(text_col)).alias("text_key"))
    ranges = staged(repeated_ranges(own, window, sketch))
    members = Members(ranges)
    schema = {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    if with_text:
        schema["kept"] = "string"

    def result(row: dict, words: list[bytes], kept: list[bytes]) -> tuple:
        text = b" ".join(kept)
        out = row["doc_id"], len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest()
        return (*out, text.decode()) if with_text else out

    def untouched(rows: Iterator[dict]) -> Iterator[tuple]:
        for part in batched(rows, 256):
            for row, member in zip(part, members.mask([row["doc_id"] for row in part])):
                if not member:
                    words = words_of(row["text"])
                    yield result(row, words, words)

    def cut(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            words = words_of(row["text"])
            kept = words
            if row["starts"]:
                step = np.zeros(len(words) + 1, np.int32)
                starts = np.array(row["starts"])
                np.add.at(step, starts, 1)
                np.add.at(step, starts + np.array(row["counts"]) + window - 1, -1)
                kept = [w for w, c in zip(words, np.cumsum(step[:-1]).tolist()) if not c]
            yield result(row, words, kept)

    # The ranges are the small side of the join, so texts need no sorting.
    joined = members.rows(own).join(ranges.hint("shuffle_hash"), ["doc_id", "text_key"], "left").select(
        "doc_id", "text", "starts", "counts")
    return map_rows(own.select("doc_id", "text"), schema, untouched).unionByName(map_rows(joined, schema, cut))
