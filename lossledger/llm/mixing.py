"""Mixing sources to target weights by systematic sampling.

Every source has a weight and the sources share the words of the whole table by these weights; a
target stops at ``most`` times its source's words, and what is above is shared anew among the others
until no target is above. A document is expected to be taken target / source words times. Within its
source, the expected copies of the documents before it are summed, one offset per source is added, and
the document is taken once for every whole number that its own share of the sum crosses. So it is taken
as often as expected, up or down to a whole number, never more than ``most`` times.

Documents stand in order of their words, then of a digest of id and text: neighbours are of like size,
so the words taken stay near the target, about as near as the largest document is long. Sums are exact
(whole numbers of 2 ** -40 copies), offsets and order come from digests: every run takes the same.

Sources are ranked and summed as tables, documents in ranges of the order (``ordered.running``); only
three numbers per round of sharing reach the driver.

Defined results: a null text has no words, and a document without words takes none; a null source is
a source of its own, the last one; a null id is a value like any other; repeated rows are each placed
for themselves, in any order among equal rows; a table without words has targets 0; an empty table gives
no rows. Other columns of the input do not matter to ``mix`` and all stay in ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import staged
from lossledger.llm.ordered import running

UNIT = 1 << 40
WEIGHTS = (1, 2, 3)
MOST = 3


def word_count(text: Column) -> Column:
    """Runs of anything but the space and the characters 9 to 13; each run becomes one letter."""
    letters = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.regexp_replace(letters, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def _share(column: Column, bits: int = 40) -> Column:
    """The first bits of a digest as a number."""
    return F.conv(F.substring(F.md5(column), 1, bits // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` (one row per source) with ``target`` words, a double."""
    ranked = running(sizes.withColumn("one", F.lit(1)), [], [F.col("source").asc_nulls_last()], {"rank": "one"})
    whole = "decimal(38,0)"
    sources = staged(ranked.select(
        "source", "source_size", (F.col("source_size") * most).alias("limit"),
        F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")))

    def above(left: int, weight: int) -> Column:
        return F.col("limit").cast(whole) * F.lit(weight).cast("decimal(18,0)") < (
            F.col("weight").cast("decimal(18,0)") * F.lit(left).cast("decimal(20,0)"))

    words, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    left, sharing = words or 0, weight or 1
    while True:
        over = above(left, sharing)
        spent, rest = sources.agg(F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight")))).first()
        now = (words or 0) - (spent or 0), rest or 1
        if now == (left, sharing):
            break
        left, sharing = now
    shared = (F.col("weight") * F.lit(left).cast("bigint")).cast("double") / F.lit(float(sharing))
    return sources.select("source", "source_size", F.when(over, F.col("limit").cast("double")).otherwise(shared).alias("target"))


def _copies(slim: DataFrame, weights: Sequence[int], most: int, seed: int) -> DataFrame:
    """``slim`` (``source, size, place`` and a row number ``_row``) with its target and its copies."""
    sizes = staged(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = staged(source_targets(sizes, weights, most))
    expected = F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(float(most))) * float(UNIT))
    rates = targets.select(
        F.col("source").alias("_of"), "source_size", "target",
        F.when(F.col("source_size") > 0, expected).otherwise(0).cast("decimal(20,0)").alias("expected"),
        _share(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))).cast("decimal(20,0)").alias("offset"))
    each = slim.join(rates, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    placed = running(each, ["source"], ["size", "place", "_row"], {"before": "expected"})
    unit = F.lit(UNIT).cast("decimal(20,0)")
    whole = lambda upto: F.call_function("div", upto, unit)
    start = F.col("before") + F.col("offset")
    return placed.withColumn("copies", whole(start + F.col("expected")) - whole(start))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    number, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(
        number.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        F.md5(F.concat(F.coalesce(number.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))).alias("place"),
        F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id().alias("_row"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 11) -> DataFrame:
    """Per document row: its words, its source's words and target, the words taken and the copies."""
    slim = staged(_slim(docs.select(id_col, text_col, source_col), id_col, text_col, source_col))
    return _copies(slim, weights, most, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 11) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as it is taken."""
    names = docs.columns
    rows = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole"),
                              F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("of"),
                              F.monotonically_increasing_id().alias("_row")))
    slim = staged(_slim(rows.select("id", "text", "of", "_row"), "id", "text", "of"))
    taken = _copies(slim, weights, most, seed).where("copies > 0").select("_row", "copies")
    return rows.join(taken, "_row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("whole.*")
