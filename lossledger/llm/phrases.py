"""Phrase collocations from sorted streams of counts.

Words are counted first, then pairs of frequent words, then runs of three words whose pairs are both
frequent, then runs of four whose threes are: a phrase that occurs ``least`` times consists of parts that do.
Which shorter phrases are frequent is known to the counting tasks through bit fields of fixed size, which let some
others pass but hold back none; counts are exact.

Each length's counts are a stream, read in two orders: by all words but the last (prefix order) and by
all words but the first (suffix order). A stream and the next shorter one run in lockstep through merge
joins, first in prefix order, which hands every phrase the counts of its beginnings, then in
suffix order, which hands it the counts of its endings. The same two orders give every phrase
the highest count among the phrases that extend it by one word to the right and to the left; longer
extensions cannot occur more often. Spark sorts the streams and splits a side of a join whose key is hot.

Scores are exact: products are decimals of 38 digits. A language's list is cut to its length in every
task before it is brought together.

Defined results: a null text has no words; a null language is ``und``; a null id does not matter;
repeated rows count each for itself; a text is one task's work, in slices of whole pieces, so a piece
must fit in memory; ties in score
and count go to the phrase that is first by its bytes; an empty table gives no rows; other columns of
the input do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import Sketch, map_batches, merged_sketch, staged
from lossledger.llm.hashing import mix, word_hashes

LONGEST = 4
LEAST = 30
TOP = 2000
FREQUENT = Sketch(depth=2, bits=24, dtype="u1", top=1)  # 32 MB whatever the corpus
HELD = 4_000_000  # bytes of text that a task counts at once
BREAK = b"\n"

_FOLD = bytearray(range(256))
_FOLD[0x41:0x5B] = range(0x61, 0x7B)  # A-Z
_FOLD[0x09] = 0x20
for _mark in b".,;:!?\x0b\x0c\r":
    _FOLD[_mark] = 0x0A
_FOLD = bytes(_FOLD)


def slices(text: str | None) -> Iterator[bytes]:
    """The text with small letters and one kind of break, in slices that end at the end of a piece."""
    folded = text.encode().translate(_FOLD) if text else b""
    start = 0
    while start < len(folded):
        end = folded.find(BREAK, start + HELD)
        end = len(folded) if end < 0 else end
        yield folded[start:end]
        start = end + 1


class Words:
    """The words of folded text: distinct ones, and for each place which one and in which piece it is."""

    def __init__(self, folded: bytes):
        letters = np.frombuffer(folded, "u1")
        inside = (letters != 0x20) & (letters != 0x0A)
        edges = np.flatnonzero(np.diff(np.r_[np.int8(0), inside.view("i1"), np.int8(0)]))
        starts = edges[::2]
        ends = np.cumsum(np.r_[0, edges[1::2] - starts]).astype("<i4")
        own = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters[inside].tobytes())])
        coded = own.dictionary_encode()
        self.distinct, self.at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.piece = np.cumsum(letters == 0x0A)[starts]

    def __len__(self) -> int:
        return len(self.at)

    def together(self, length: int) -> np.ndarray:
        """Whether the run of ``length`` words that begins at a place is in one piece."""
        return self.piece[: len(self) - length + 1] == self.piece[length - 1 :]


Counts = Iterator[tuple[pa.Array, np.ndarray]]


def _counted(docs: DataFrame, phrases: Callable[[str, Words], Counts]) -> DataFrame:
    """``lang, phrase, f``: counts over all tasks; words of a phrase are parted by line ends, which no word holds."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                words = Words(BREAK.join(parts))
                parts.clear()
                for found, n in phrases(lang, words):
                    for start in range(0, len(found), 20_000):
                        some = found.slice(start, 20_000).cast(pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(lang, len(some)), some, pa.array(n[start : start + 20_000], pa.int64())], schema=schema)
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(*(column for column in batch.columns)):
                for part in slices(text.as_py()):
                    held.setdefault(lang.as_py(), []).append(part)
                    size += len(part)
                    if size > HELD:
                        yield from flush()
                        size = 0
        yield from flush()

    partial = map_batches(docs.select("lang", "text"), count, "lang string, phrase string, n bigint")
    return partial.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _words(lang: str, words: Words) -> Counts:
    yield words.distinct, np.bincount(words.at, minlength=len(words.distinct))


def _word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    return mix(word_hashes(words) + word_hashes([lang.encode() + BREAK]))


def _run_keys(words: np.ndarray, length: int) -> np.ndarray:
    """One key for each run of ``length`` neighbours, from the keys of the words in a row."""
    count = max(0, len(words) - length + 1)
    runs = words[:count]
    for i in range(1, length):
        runs = mix(runs * np.uint64(3) + mix(words[i : i + count]))
    return runs


def _bits(frequent: DataFrame) -> np.ndarray:
    """The bit field of the frequent phrases of a language; all have the same number of words."""

    def keys(row: dict) -> np.ndarray:
        words = _word_keys(row["lang"], row["phrase"].encode().split(BREAK))
        return _run_keys(words, len(words))

    return merged_sketch(frequent.select("lang", "phrase"), FREQUENT, keys)


class Runs:
    """Runs of words, one for each place: distinct ones as (shorter run, last word), and which each is."""

    def __init__(self, shorter: np.ndarray, last: np.ndarray, words: Words, joined: pa.Array):
        code, self.at, self.counts = np.unique(shorter * len(words.distinct) + last, return_inverse=True, return_counts=True)
        first, last = code // max(1, len(words.distinct)), code % max(1, len(words.distinct))
        self.joined = pc.binary_join_element_wise(
            joined.take(pa.array(first)), words.distinct.take(pa.array(last)), pa.scalar(BREAK, pa.binary()))


def _runs(cells, length: int) -> Callable[[str, Words], Counts]:
    """Runs of ``length`` words in one piece both of whose runs of one word less may be frequent."""

    def find(lang: str, words: Words) -> Counts:
        if len(words) < length:
            return
        keys = _run_keys(_word_keys(lang, words.distinct.to_pylist())[words.at], length - 1)
        often = FREQUENT.estimate(cells.value, keys) > 0
        del keys
        place = np.flatnonzero(often[:-1] & often[1:] & words.together(length))
        at, joined = words.at[place], words.distinct
        for i in range(1, length):
            runs = Runs(at, words.at[place + i], words, joined)
            at, joined = runs.at, runs.joined
        yield joined, runs.counts

    return find


def count_streams(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """The number of words per language, and the counts of frequent phrases, one table per length."""
    context = texts.sparkSession.sparkContext
    words = staged(_counted(texts, _words))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = f"f >= {least}"
    streams = [words.where(often)]
    for length in range(2, LONGEST + 1):
        cells = context.broadcast(_bits(streams[-1]))
        streams.append(staged(_counted(texts, _runs(cells, length)).where(often)))
        cells.unpersist()
    return total, streams


def _neighbours(stream: DataFrame) -> DataFrame:
    """A stream of phrases with all words but the last and all words but the first."""
    return stream.withColumns({"head": F.regexp_extract("phrase", r"(?s)^(.*)\n", 1),
                               "tail": F.regexp_extract("phrase", r"\n((?s:.*))$", 1)})


def scored(streams: list[DataFrame], percent: int = 80) -> DataFrame:
    """Candidates with their lowest-scoring cut and whether a longer phrase stands for them."""
    shorter = streams[0].withColumns({"begins": F.array("f"), "ends": F.array("f")})
    levels = []
    for stream in streams[1:]:
        # counts of the first 1, 2, ... words in prefix order and of the last 1, 2, ... words in suffix order
        left = shorter.select("lang", F.col("phrase").alias("head"), F.col("begins").alias("_begins")).hint("merge")
        right = shorter.select("lang", F.col("phrase").alias("tail"), F.col("ends").alias("_ends")).hint("merge")
        met = _neighbours(stream).join(left, ["lang", "head"]).join(right, ["lang", "tail"])
        shorter = staged(met.select("lang", "phrase", "head", "tail", "f",
                                    F.concat("_begins", F.array("f")).alias("begins"),
                                    F.concat("_ends", F.array("f")).alias("ends")))
        levels.append(shorter)
    out = []
    for i, level in enumerate(levels):
        if i + 1 < len(levels):
            longer = levels[i + 1]
            beyond = [longer.groupBy("lang", F.col(side).alias("phrase")).agg(F.max("f").alias(f"by_{side}")).hint("merge")
                      for side in ("head", "tail")]
            level = reduce(lambda a, b: a.join(b, ["lang", "phrase"], "left"), beyond, level)
            most = F.greatest(F.coalesce("by_head", F.lit(0)), F.coalesce("by_tail", F.lit(0)))
        else:
            most = F.lit(0)
        out.append(level.select("lang", "phrase", F.col("f").alias("a"), _lowest_cut(i + 2).alias("cut"), (
            F.lit(100).cast("decimal(18,0)") * most.cast("decimal(20,0)")
            >= F.lit(percent).cast("decimal(18,0)") * F.col("f").cast("decimal(20,0)")).alias("covered")))
    return reduce(DataFrame.unionByName, out).select("lang", "phrase", "a", "cut.*", "covered")


def _lowest_cut(length: int):
    """The cut after k words whose score is lowest, then whose k is smallest."""
    cuts = []
    for k in range(1, length):
        l, r = F.get("begins", F.lit(k - 1)), F.get("ends", F.lit(length - k - 1))
        both = l.cast("decimal(20,0)") + r.cast("decimal(20,0)")
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(18,0)") * F.col("f").cast("decimal(20,0)"), both)
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
                 percent: int = 80) -> DataFrame:
    """Per language the best phrases of two to four words: rank, phrase, counts and score."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    total, streams = count_streams(texts, least)
    kept = scored(streams, percent).where("NOT covered").withColumn("phrase", F.translate("phrase", "\n", " "))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    listed = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return listed.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
