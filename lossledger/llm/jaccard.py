"""Jaccard join of word n-gram sets: subsets for small sets, inverted lists for large ones.

Equal sets are one set from the start, so only different sets are joined.

*Small sets.* Two sets of ``m`` and ``n`` elements that reach the threshold ``t`` differ in at most
``(m + n)(1 - t) / (1 + t)`` elements, which is very few here. Each small set therefore sends all its
subsets that lack up to ``t``-many elements; sets that link share one of them. Among the sets that
share a subset, every pair that is small enough for the subset to prove the link is also small
enough together with the smallest set, so links to that one set are enough for the classes.

*Large sets.* The elements are ordered by how rare their rarest word is; each set enters the
inverted lists of its first (rarest) elements, as many as a linked set cannot miss altogether. A
list first links its sets to its smallest id of similar size; then sets of one list that are not yet
in one class are compared pairwise, in rounds: first the few likeliest pairs of each set in a list, then, in the
lists that held pairs back, sixteen times as many of those that are still in different classes, until none is
held back. Near copies are one class after a few of their pairs. Each set has a bit field with some four bits per element; a bit that
only one of two sets has stands for an element the other lacks, which bounds the intersection from above
and rejects nearly all candidates that are not linked. What is left is compared element by element.

The boundary between the two is the size at which the summed costs, subsets sent against list
entries scanned, are least.

Defined results: a null or wordless text has an empty set and is linked with nothing; fewer than
``n`` words are one element; an id that is null is no link and has no class (null); rows that share
an id are one node with all their sets; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations, groupby
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import Sketch, map_rows, merged_sketch, removed_after, staged
from lossledger.llm.components import components
from lossledger.llm.hashing import mix, run_hashes, word_hashes

WORD_COUNTS = Sketch(depth=1, bits=22, dtype="u4", top=2**32 - 1)  # 16 MB whatever the corpus
MEMBERS = Sketch(depth=2, bits=24, dtype="u1", top=1)  # 32 MB whatever the number of candidates
FIELD = 256, 2048  # bits of the field of a set, from the fewest to the most
BRIEF = 512  # bits of a field that goes with every entry of a list
BLOCK_SETS = 512
FEW, MORE = 2, 16  # pairs that a set sends from a list in the first round, and times as many in each later one
EARLIER = 6  # elements that go with every entry of a list, to tell pairs that an earlier list has sent
SMALL_LIMIT = 29  # larger sets would send hundreds of subsets each
SUBSET_COST = 1.0
LIST_COST = 0.02  # of an entry scanned, most of which a size or class bound rejects


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def shingles(text: str | None, n: int) -> np.ndarray:
    """Hashes of the distinct n-grams of words, sorted; the whole text if it is shorter."""
    hashes = word_hashes(words_of(text))
    if not len(hashes):
        return hashes
    return np.unique(run_hashes(hashes, min(n, len(hashes))))


class Threshold:
    """Exact integer tests of ``100 * intersection >= percent * union``."""

    def __init__(self, percent: int):
        self.percent = percent

    def linked(self, common: int, m: int, n: int) -> bool:
        return 100 * common >= self.percent * (m + n - common)

    def overlap(self, m: int, n: int) -> int:
        """The least intersection of linked sets of ``m`` and ``n`` elements."""
        return -(-self.percent * (m + n) // (100 + self.percent))

    def least_partner(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        """So many first elements of a set cannot all be missing from a linked set."""
        return n - self.least_partner(n) + 1

    def missing(self, n: int) -> int:
        """A set of ``n`` elements lacks at most so many of them in a subset shared with a linked set."""
        return n - self.least_partner(n)


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Word counts as one byte each, in eighths of a power of two."""
    return np.minimum(255, 8 * np.log2(counts.astype(float) + 1)).astype("u1")


def _rarest(hashes: np.ndarray, length: int, first: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rank of the rarest word of the n-grams that begin at ``first``."""
    seen = WORD_COUNTS.estimate(ranks, hashes)
    rarest = seen[first]
    for i in range(1, length):
        rarest = np.minimum(rarest, seen[first + i])
    return rarest


def _sets(docs: DataFrame, n: int, limit: Threshold, ranks) -> DataFrame:
    """Per row: set size, key of the set, first elements, bit field, and small sets in full."""

    def build(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            hashes = word_hashes(words_of(row["text"]))
            if not len(hashes):
                yield row["doc_id"], 0, None, None, None, None, None, 0.0
                continue
            length = min(n, len(hashes))
            elements, first = np.unique(run_hashes(hashes, length), return_index=True)
            size = len(elements)
            # numbers whose order is rarity of the rarest word, then hash: one order for all sets
            ranked = (_rarest(hashes, length, first, ranks.value).astype("u8") << np.uint64(56)) | (elements >> np.uint64(8))
            wanted = limit.prefix(size)
            if wanted < size:
                ranked = np.partition(ranked, wanted - 1)[:wanted]
            small = size <= SMALL_LIMIT
            yield (row["doc_id"], size, *_key(elements), ranked.view("i8").tolist(),
                   _field(elements), elements.view("i8").tolist() if small else None,
                   float(np.exp2((ranked >> np.uint64(56)).astype(float) / 8).sum()) if small else 0.0)

    return map_rows(docs, {"doc_id": "bigint", "n": "int", "key_a": "bigint", "key_b": "bigint",
                           "prefix": "array<bigint>", "field": "binary", "elements": "array<bigint>",
                           "scan": "double"}, build)


def _field(elements: np.ndarray) -> bytes:
    """One bit for each remainder of an element; so many bits that most elements have one of their own."""
    bits = min(FIELD[1], max(FIELD[0], 1 << (4 * len(elements) - 1).bit_length()))
    held = np.zeros(bits, bool)
    held[(elements & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def _folded(fields: np.ndarray, width: int) -> np.ndarray:
    """Fields (in the last axis) cut down to ``width`` numbers: the same elements with fewer remainders."""
    while fields.shape[-1] > width:
        half = fields.shape[-1] // 2
        fields = fields[..., :half] | fields[..., half:]
    return fields


def _most_common(field: np.ndarray, size: int, fields: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest possible intersections of a set with others, by their fields."""
    width = min(field.shape[-1], fields.shape[-1])
    field, fields = _folded(field, width), _folded(fields, width)
    only_one = np.bitwise_count(field & ~fields).sum(axis=1, dtype=np.int64)
    only_others = np.bitwise_count(fields & ~field).sum(axis=1, dtype=np.int64)
    return np.minimum(size - only_one, sizes - only_others)


def _signed(number: np.uint64) -> int:
    return int(np.uint64(number).view("i8"))


def _key(elements: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set that does not depend on order."""
    second = mix(elements * np.uint64(3) + np.uint64(1)).sum(dtype="u8")
    return _signed(mix(elements).sum(dtype="u8")), _signed(second + np.uint64(len(elements)))


def boundary(sets: DataFrame, limit: Threshold) -> int:
    """The largest size that sends subsets; at most SMALL_LIMIT rows of statistics reach the driver."""
    stats = {r["n"]: (r["sets"], r["scan"]) for r in sets.where(F.col("n").between(1, SMALL_LIMIT)).groupBy("n").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("scan").alias("scan")).collect()}
    subsets = lambda n: sum(comb(n, i) for i in range(limit.missing(n) + 1))
    best, best_cost = 0, None
    for size in range(SMALL_LIMIT + 1):
        cost = sum(SUBSET_COST * c * subsets(n) for n, (c, _) in stats.items() if n <= size) + sum(
            c * limit.prefix(n) + LIST_COST * scan for n, (c, scan) in stats.items() if n > size)
        if best_cost is None or cost < best_cost:
            best, best_cost = size, cost
    return best


def _small_links(sets: DataFrame, largest: int, limit: Threshold) -> DataFrame:
    """Edges between sets of at most ``largest`` elements that share a subset proving the link."""

    def subsets(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            elements = np.array(row["elements"], "i8").view("u8")
            n = len(elements)
            a, b = mix(elements), mix(elements * np.uint64(3) + np.uint64(1))
            all_a, all_b = a.sum(dtype="u8"), b.sum(dtype="u8")
            for lacking in range(limit.missing(n) + 1):
                for gone in combinations(range(n), lacking):
                    gone = list(gone)
                    yield (int((all_a - a[gone].sum(dtype="u8")).view("i8")),
                           int((all_b - b[gone].sum(dtype="u8")).view("i8")), n - lacking, row["doc_id"], n)

    sent = map_rows(sets.where(F.col("n").between(1, largest)).select("doc_id", "elements"), {
        "sub_a": "bigint", "sub_b": "bigint", "common": "int", "doc_id": "bigint", "n": "int"}, subsets)
    key = ["sub_a", "sub_b", "common"]
    centre = sent.groupBy(*key).agg(F.min(F.struct("n", "doc_id")).alias("centre"), F.count(F.lit(1)).alias("sets")).where(
        "sets > 1").select(*key, F.col("centre.n").alias("m"), F.col("centre.doc_id").alias("a"))
    proven = 100 * F.col("common") >= limit.percent * (F.col("m") + F.col("n") - F.col("common"))
    return sent.join(centre, key).where((F.col("doc_id") != F.col("a")) & proven).select(
        "a", F.col("doc_id").alias("b")).distinct()


def _possible(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs whose bit fields allow a link; no linked pair is lost. Only fields of documents in pairs travel."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    # stored, so that no task needs two Python workers
    own = staged(sets.select("doc_id", "n", "field").where(MEMBERS.may_hold(members, "doc_id")))

    def test(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            one, other = np.frombuffer(row["fa"], "u8"), np.frombuffer(row["fb"], "u8")
            if _most_common(one, row["na"], other[None], np.array([row["nb"]]))[0] >= limit.overlap(row["na"], row["nb"]):
                yield row["a"], row["b"]

    first = own.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("field").alias("fa"))
    second = own.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("field").alias("fb"))
    return map_rows(pairs.join(first, "a").join(second, "b").select("a", "b", "na", "nb", "fa", "fb"), {
        "a": "bigint", "b": "bigint"}, test)


def _verified(pairs: DataFrame, docs: DataFrame, n: int, limit: Threshold) -> DataFrame:
    """The pairs that are linked, compared element by element.

    The texts travel to their pairs, packed: they are shorter than their elements, which are made anew there.
    """
    holds = MEMBERS.holder(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), "doc_id")

    def packed(rows: Iterator[dict]) -> Iterator[tuple]:
        """Only documents that may be in a pair; a few others pass as well."""
        for row in rows:
            if holds(np.array([row["doc_id"]], "i8"))[0]:
                yield row["doc_id"], zlib.compress((row["text"] or "").encode())

    # stored, so that no task needs two Python workers
    found = staged(map_rows(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), {
        "doc_id": "bigint", "text": "binary"}, packed, size=64))
    first = found.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    second = found.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))

    def test(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            one, other = (shingles(zlib.decompress(row[c]).decode(), n) for c in ("x", "y"))
            if limit.linked(len(np.intersect1d(one, other, assume_unique=True)), len(one), len(other)):
                yield row["a"], row["b"]

    return staged(map_rows(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y"), {
        "a": "bigint", "b": "bigint"}, test).distinct())


def _unlinked(lists: DataFrame, sets: DataFrame, small: int, limit: Threshold, most: int | None = None) -> DataFrame:
    """Pairs within a list that are in different classes and may be linked.

    With ``most`` a set sends so many pairs with smaller ones at once, those whose bit fields leave the most to spare;
    a list that holds others back says so by a row with its element as ``a`` and no ``b``.

    A list is cut into ``blocks`` blocks of bounded size and each pair of blocks is one unit of work, so a
    long list is spread over many tasks. Pairs are compared inside the unit, by sizes and by bit fields; only
    those that pass leave it. The fields travel once, to their units, cut down to ``BRIEF`` bits: one goes with
    each entry, so they are most of what travels.

    Near copies share many lists. Whether a pair passes does not depend on the list, so a list leaves out pairs
    that it can tell to be in an earlier one, by the ``EARLIER`` last elements of both sets before its own. The
    first list of a pair has no earlier one, so it always sends the pair or holds it back.
    """
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")

    def cut(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            yield row["doc_id"], row["n"], _folded(np.frombuffer(row["field"], "u8"), BRIEF // 64).tobytes()

    brief = map_rows(sets.select("doc_id", "n", "field"), {"doc_id": "bigint", "n": "int", "field": "binary"}, cut)
    # dealt as the join deals, so this shuffles nothing more
    before = Window.partitionBy("doc_id", "n").orderBy("element").rowsBetween(-EARLIER, -1)
    full = lists.withColumn("earlier", F.collect_list("element").over(before)).join(brief, ["doc_id", "n"])
    sent = full.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "element", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own",
        "doc_id", "n", "class", "field", "earlier")
    unit = ["element", "low", "high"]

    def compare(rows: Iterator[dict]) -> Iterator[tuple]:
        for (element, low, high), members in groupby(rows, key=lambda r: (r["element"], r["low"], r["high"])):
            members = list(members)
            widths = np.array([len(r["field"]) for r in members])
            fields = {w: np.array([np.frombuffer(r["field"], "u8") for r in members if len(r["field"]) == w]) for w in set(widths.tolist())}
            within = np.zeros(len(members), np.int64)  # place of a member among those with a field as wide
            for w in fields:
                within[widths == w] = np.arange((widths == w).sum())
            earlier = [frozenset(r["earlier"]) for r in members]
            ids, sizes, kinds, blocks = (np.array([r[c] for r in members]) for c in ("doc_id", "n", "class", "own"))
            back = False
            for i in range(len(members)):
                other = (kinds != kinds[i]) & (100 * sizes >= limit.percent * sizes[i])
                other &= (sizes < sizes[i]) | ((sizes == sizes[i]) & (ids < ids[i]))
                if low != high:
                    other &= blocks != blocks[i]
                if sizes[i] <= small or not other.any():
                    continue
                spare = np.full(len(members), -1)
                for w in set(widths[other].tolist()):
                    at = np.flatnonzero(other & (widths == w))
                    bound = _most_common(fields[int(widths[i])][within[i]], int(sizes[i]), fields[w][within[at]], sizes[at])
                    spare[at] = bound + -limit.percent * (sizes[at] + sizes[i]) // (100 + limit.percent)
                may = np.flatnonzero(spare >= 0)
                own_sent = 0
                for j in may[np.argsort(-spare[may], kind="stable")].tolist():
                    if earlier[i].isdisjoint(earlier[j]):
                        if own_sent == most:
                            back = True
                            break
                        own_sent += 1
                        yield int(ids[j]), int(ids[i])
            if back:
                yield element, None

    return map_rows(sent.repartition(*unit).sortWithinPartitions(*unit), {"a": "bigint", "b": "bigint"}, compare).distinct()


def _large_links(sets: DataFrame, docs: DataFrame, small: int, links: DataFrame, n: int, limit: Threshold) -> DataFrame:
    """All links with at least one set of more than ``small`` elements, as far as classes need them."""
    entries = sets.where(F.col("n") >= limit.least_partner(small + 1)).select(
        F.explode("prefix").alias("element"), "doc_id", "n",
        F.floor(F.log(F.col("n")) / np.log(100 / limit.percent)).alias("band"))
    # stored first: its size is known when the join is planned, and the entries are shuffled only if it is large
    shared = staged(entries.groupBy("element").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("element"))
    lists = staged(entries.join(shared, "element", "left_semi"))

    centres = lists.groupBy("element", "band").agg(F.min("doc_id").alias("a"))
    stars = lists.join(centres, ["element", "band"]).where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct()
    tried = staged(_possible(staged(stars), sets, limit))
    near = _verified(tried, docs, n, limit)

    most = FEW
    while True:
        classes = staged(components(links.unionByName(near)))
        classed = lists.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
            "class", F.coalesce("component", "doc_id")).select("element", "doc_id", "n", "class")
        mixed = classed.groupBy("element").agg(
            F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("sets")).where(
            "low != high").select("element", F.ceil(F.col("sets") / BLOCK_SETS).cast("int").alias("blocks"))
        open_lists = staged(classed.join(mixed, "element"))
        found = staged(_unlinked(open_lists, sets, small, limit, most))
        known = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rest = staged(found.where("b IS NOT NULL").join(known, ["a", "b"], "left_anti"))
        # those that the short fields let through meet the whole ones
        near = near.unionByName(_verified(staged(_possible(rest, sets, limit)), docs, n, limit))
        back = found.where("b IS NULL").select(F.col("a").alias("element"))
        if back.isEmpty():
            return near
        # only lists that held pairs back come again; what was sent meets no second test
        lists = staged(open_lists.select("element", "doc_id", "n").join(back, "element", "left_semi"))
        tried, most = tried.unionByName(rest), most * MORE


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3,
                    percent: int = 90) -> DataFrame:
    """Per document row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id of its class."""
    limit = Threshold(percent)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = merged_sketch(own.select("text"), WORD_COUNTS, lambda row: word_hashes(words_of(row["text"])))
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(counts))  # 4 MB whatever the corpus
    every = staged(_sets(own, n, limit, ranks))
    key = ["key_a", "key_b"]
    first = every.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("doc_id"))
    sets = staged(every.join(first, [*key, "doc_id"], "left_semi").dropDuplicates([*key, "doc_id"]))
    small = boundary(sets, limit)
    links = staged(_small_links(sets, small, limit).unionByName(_own_sets(every, first, key)))
    links = links.unionByName(_large_links(sets, own, small, links, n, limit))
    return _with_classes(every, first, components(links), key)


def _own_sets(every: DataFrame, first: DataFrame, key: list[str]) -> DataFrame:
    """An id with several texts holds their sets together: edges to the first document of each."""
    sets = every.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", *key).distinct()
    several = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("doc_id")
    return sets.join(several, "doc_id", "left_semi").join(first.withColumnRenamed("doc_id", "a"), key).where(
        "doc_id != a").select("a", F.col("doc_id").alias("b"))


def _with_classes(every: DataFrame, first: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Each row takes the class of the first document with its set."""
    labelled = first.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        *key, F.coalesce("component", "doc_id").alias("component_id"))
    return every.select("doc_id", "n", *key).join(labelled, key, "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int, percent: int) -> DataFrame:
    """``docs`` with one row of each class of linked rows, the one with the smallest id; all columns stay.

    Rows are linked by their own texts, whatever their ids: of rows that share an id, too, one of each
    class stays (the first stored), and a row without an id is linked like any other and stays only if
    its class has no id. A null or wordless text is linked with nothing; of such rows only repeats of
    one id and text go, and those without an id stay. An empty table gives no rows. What is stored on
    the way is removed, but for the numbered rows and a few numbers, which the result reads.
    """
    # a name that no column of the documents has
    number = "_row" + "_" * max((len(name) for name in docs.columns), default=0)
    rows = staged(docs.withColumn(number, F.monotonically_increasing_id()), keep=True)
    with removed_after(docs.sparkSession):
        classes = jaccard_classes(rows, id_col=number, text_col=text_col, n=n, percent=percent).withColumnRenamed(
            "doc_id", "_row")
        alone = (F.col("n_shingles") == 0) & F.col("_own").isNotNull()
        classed = staged(rows.select(
            F.col(number).alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_text")).join(
            classes, "_row").select(
            "_row", "_own", F.when(~alone, F.col("component_id")).alias("_class"),
            F.when(alone, F.col("_own")).alias("_id"), F.when(alone, F.col("_text")).alias("_text")))
        first = F.min(F.struct(F.col("_own").isNull().alias("no_id"), "_own", "_row"))
        kept = classed.groupBy("_class", "_id", "_text").agg(first.alias("first")).select("first._row")
        others = staged(classed.select("_row").join(kept, "_row", "left_anti").select(F.col("_row").alias(number)))
        # the texts stay where they are: the few rows that only seem to go are told by their numbers
        seems = MEMBERS.may_hold(others, number)
        stay = staged(rows.select(number).where(seems).join(others, number, "left_anti"), keep=True)
    return rows.where(~seems).unionByName(rows.where(seems).join(stay, number, "left_semi")).drop(number)
