"""Benchmark decontamination by Wu-Manber search over words.

Words are the symbols of the search. All windows of one length share a table: the last
``BLOCK`` words under the search position give a shift, which skips every position at which no
window can end; where the shift is zero, the bucket of that suffix names the windows to compare
word by word. A document is one pass over its words, without a shuffle.

Defined results: a null text has no words and no hits; an item without words has no window and
is never counted; repeated document rows are judged each for itself; items that share an id count
as one item; nulls in ``item_id`` take no part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from lossledger.llm.common import map_rows

WINDOW = 13
BLOCK = 3
#: Bytes of benchmark text that one broadcast may hold; a larger benchmark is searched in blocks.
MAX_PATTERN_BYTES = 32_000_000

# Letters A-Z become small; the rest of ASCII but digits and small letters separates words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class _Windows:
    """Windows of one length: shift table, suffix buckets and the windows themselves."""

    def __init__(self, length: int, owners: dict[tuple[bytes, ...], set]):
        self.length, self.owners = length, owners
        self.block = min(BLOCK, length)
        self.farthest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for window in owners:
            for end in range(self.block, length + 1):
                seen = window[end - self.block : end]
                self.shift[seen] = min(self.shift.get(seen, self.farthest), length - end)
            self.bucket[window[-self.block :]].append(window)
        # A suffix shared by many windows is told apart by the words before it, again by hashing.
        self.deep = {s: set(ws) for s, ws in self.bucket.items() if len(ws) > 4}

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Start and window of every occurrence, from left to right."""
        end, block, length = self.length, self.block, self.length
        shift, farthest, n = self.shift.get, self.farthest, len(words)
        while end <= n:
            suffix = tuple(words[end - block : end])
            skip = shift(suffix, farthest)
            if skip:
                end += skip
                continue
            here = tuple(words[end - length : end])
            known = self.deep.get(suffix)
            if here in known if known is not None else any(here == w for w in self.bucket[suffix]):
                yield end - length, here
            end += 1


def build_tables(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[_Windows]:
    by_length: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = words_of(text)
        if item_id is None or not words:
            continue
        length = min(window, len(words))
        for start in range(len(words) - length + 1):
            by_length[length][tuple(words[start : start + length])].add(item_id)
    return [_Windows(length, dict(owners)) for length, owners in sorted(by_length.items())]


def search(words: list[bytes], tables: list[_Windows]) -> tuple[list[tuple[int, int]], set]:
    """Covered word ranges [start, end), merged and in order, and the items found."""
    ranges, found = [], set()
    for table in tables:
        for start, window in table.occurrences(words):
            ranges.append((start, start + table.length))
            found |= table.owners[window]
    merged: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged, found


SPANS = {"n_words": "bigint", "starts": "array<int>", "ends": "array<int>", "items": "array<bigint>"}


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list]:
    """The benchmark's rows in blocks of about ``limit`` bytes of text, one after the other."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(
        "id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // limit) or 1
    number = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for block in range(blocks):
        yield [(r["id"], r["text"]) for r in items.where(number == block).collect()]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                   max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """Per document row: ``doc_id``, ``n_words``, covered word ranges and the ids of items found."""
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = []
    for items in benchmark_blocks(benchmark, item_col, item_text_col, max_pattern_bytes):
        shared = context.broadcast(items)

        def scan(rows: Iterator[dict], shared=shared) -> Iterator[tuple]:
            tables = build_tables(shared.value, window)
            for row in rows:
                words = words_of(row["text"])
                ranges, found = search(words, tables)
                yield (row["doc_id"], *([row["key"]] if "key" in row else []), len(words),
                       [s for s, _ in ranges], [e for _, e in ranges], sorted(found))

        parts.append(scan)
    if len(parts) == 1:
        return map_rows(slim, {"doc_id": "bigint"} | SPANS, parts[0])
    # Each block of a large benchmark is a scan of its own; the ranges of a document meet by its key.
    keyed = slim.withColumn("key", F.xxhash64("text"))
    every = None
    for part in parts:
        one = map_rows(keyed, {"doc_id": "bigint", "key": "bigint"} | SPANS, part)
        every = one if every is None else every.unionByName(one)
    met = every.where(F.size("starts") > 0).groupBy("doc_id", "key").agg(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join_up(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            starts, ends = [], []
            for pair in row["ranges"] or []:
                if starts and pair["starts"] <= ends[-1]:
                    ends[-1] = max(ends[-1], pair["ends"])
                else:
                    starts.append(pair["starts"])
                    ends.append(pair["ends"])
            yield row["doc_id"], row["n_words"], starts, ends, row["items"] or []

    counted = map_rows(keyed, {"doc_id": "bigint", "key": "bigint", "n_words": "bigint"},
                       lambda rows: ((r["doc_id"], r["key"], len(words_of(r["text"]))) for r in rows))
    own, other = counted.alias("a"), met.alias("b")
    same = F.expr("a.doc_id <=> b.doc_id AND a.key <=> b.key")
    joined = own.join(other, same, "left").select("a.doc_id", "a.n_words", "b.ranges", "b.items")
    return map_rows(joined, {"doc_id": "bigint"} | SPANS, join_up)


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Digest of :func:`benchmark_hits`: counts, the items found and the verdict, per document row."""

    def digest(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            hit = sum(e - s for s, e in zip(row["starts"], row["ends"]))
            names = ",".join(sorted(map(str, row["items"])))
            yield (row["doc_id"], row["n_words"], hit, len(row["items"]),
                   hashlib.sha256(names.encode()).hexdigest(), is_contaminated(hit, row["n_words"]))

    return map_rows(benchmark_hits(docs, benchmark, **options), {
        "doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint",
        "items_sha256": "string", "contaminated": "boolean"}, digest)


def contamination_filter(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                         item_text_col: str = "text", window: int = WINDOW,
                         max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay and nothing is shuffled.

    A benchmark of several blocks is searched block after block within one task.
    """
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(b) for b in benchmark_blocks(benchmark, item_col, item_text_col, max_pattern_bytes)]

    @pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = [build_tables(block.value, window) for block in shared]
        for texts in parts:
            verdicts = []
            for text in texts:
                words = words_of(text)
                hit = np.zeros(len(words), bool)
                for table in tables:
                    for start, end in search(words, table)[0]:
                        hit[start:end] = True
                verdicts.append(not is_contaminated(int(hit.sum()), len(words)))
            yield pd.Series(verdicts, dtype=bool)

    return docs.where(clean(F.col(text_col)))
