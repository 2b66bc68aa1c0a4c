"""Conversation prefix trie: shared beginnings, and what storing them once would save.

Conversations are rebuilt turn by turn; equal beginnings are one node. A node is known by the running sum
of hashes of (depth, role, text), so a conversation of any length is spread over tasks. Its members are
counted by one aggregation with partial sums. Nodes with equal members form a chain, which is known by its
smallest member and the number of members, and is one node of the balanced-parentheses encoding.

The chains at which conversations end are sorted by their path of smallest members and cut into shards. A
shard writes its part of the trie as balanced parentheses: an array of +1 and -1 whose running sum, the
excess, is kept with the least excess of each block and of groups of blocks. ``findclose`` skips whole
blocks by these and so delimits a subtree; the rank of pairs that open and close at once counts its leaves,
and the running sum of savings in order of opening gives its savings. A path that begins in
one shard and goes on in the next is in both; a chain's own savings and its place below its parent
are booked by the shard in which it comes first, so the values of shared spines are merged by adding them.

Bounds: a path holds one number per chain, and each chain above another needs a conversation of its own
that leaves there, so a path is no longer than the square root of twice the number of turns. A digest of all
members that end at a node is one sequential sum: their ids are joined in sorted blocks by many tasks, and
one task per node reads the blocks in turn, however many there are; it holds one at a time.

Defined results: rows without a conversation id take no part; a null role or text is empty; a null turn
comes first; equal turn numbers are ordered by a digest of role and text; repeated rows are turns of
their own; the hundreds of negative ids are cut towards zero; a conversation left without turns ends at
the root; an empty table has no
conversations and gives no rows, not even a root; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import map_rows, staged
from lossledger.llm.ordered import running

PRIME = (1 << 61) - 1
HEADS = 6  # conversations begin with fewer turns than this of their hundred's first one
BLOCK = 64
IDS = 4096  # ids joined into one block of a digest's text


class Parentheses:
    """A balanced sequence of +1 (open) and -1 (close) with a range min-max tree over its excess."""

    def __init__(self, steps: np.ndarray):
        self.steps = np.asarray(steps, np.int8)
        self.excess = np.cumsum(self.steps, dtype=np.int64)
        self.levels = []
        least = self.excess
        while len(least) > 1 or not self.levels:
            filled = np.full(-(-len(least) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
            filled[: len(least)] = least
            least = filled.reshape(-1, BLOCK).min(axis=1)
            self.levels.append(least)
            if not len(least):
                break
        self.opens = np.flatnonzero(self.steps > 0)
        pair = np.zeros(len(self.steps) + 1, np.int64)
        pair[1:-1] = np.cumsum((self.steps[:-1] > 0) & (self.steps[1:] < 0))
        if len(pair) > 1:
            pair[-1] = pair[-2]
        self.pairs = pair  # pairs[i]: pairs "()" that begin before place i

    def _first_below(self, start: int, bound: int) -> int:
        """The first place from ``start`` on whose excess is at most ``bound``."""
        stop = min(len(self.excess), -(-start // BLOCK) * BLOCK)
        low = np.flatnonzero(self.excess[start:stop] <= bound)
        if len(low):
            return start + int(low[0])
        place, level = stop // BLOCK, 0
        while True:  # up: skip blocks whose least excess is above the bound
            blocks = self.levels[level]
            stop = min(len(blocks), -(-place // BLOCK) * BLOCK)
            low = np.flatnonzero(blocks[place:stop] <= bound)
            if len(low):
                place += int(low[0])
                break
            place, level = stop // BLOCK, level + 1
        for lower in range(level - 1, -1, -1):  # down: into the first block that goes so low
            part = self.levels[lower][place * BLOCK : (place + 1) * BLOCK]
            place = place * BLOCK + int(np.flatnonzero(part <= bound)[0])
        part = self.excess[place * BLOCK : (place + 1) * BLOCK]
        return place * BLOCK + int(np.flatnonzero(part <= bound)[0])

    def findclose(self, place: int) -> int:
        """Where the parenthesis opened at ``place`` is closed."""
        return self._first_below(place + 1, int(self.excess[place]) - 1)

    def rank_open(self, place: int) -> int:
        """Parentheses opened before ``place``."""
        return (place + int(self.excess[place - 1])) // 2 if place else 0


def shard_subtrees(paths: list[tuple[list[tuple], bool]]) -> Iterator[tuple]:
    """Partial values of the chains of one shard.

    ``paths``: sorted; per ending chain its path and whether it goes on below. A path is a list of chains
    ``(smallest member, members, savings, members ending there)`` from the root chain down. Yields chain,
    parent's smallest member, and the shard's share of children, leaves and savings below and including it.
    """
    steps: list[int] = []
    chains: list[tuple] = []
    saved: list[int] = []
    born: list[int] = []
    open_now: list[int] = []
    for path, goes_on in paths:
        common = 0
        while common < min(len(open_now), len(path)) and chains[open_now[common]][:2] == path[common][:2]:
            common += 1
        steps.extend([-1] * (len(open_now) - common))
        del open_now[common:]
        for at in range(common, len(path)):
            chain = path[at]
            # first met here in the whole order: the smallest member ends on this path, and nobody ends between
            first = chain[0] == path[-1][0] and not any(c[3] for c in path[at:-1])
            open_now.append(len(chains))
            chains.append((chain[0], chain[1], path[at - 1][0] if at else None))
            saved.append(chain[2] if first else 0)
            born.append(int(first))
            steps.append(1)
    steps.extend([-1] * len(open_now))
    tree = Parentheses(np.array(steps, np.int8))
    total = np.r_[0, np.cumsum(np.array(saved, np.int64))] if chains else np.zeros(1, np.int64)
    children = np.zeros(len(chains), np.int64)
    # the last ending of a shard may go on in the next one: it looks like a leaf here
    unfinished = int(tree.opens[-1]) if paths and paths[-1][1] and tree.steps[tree.opens[-1] + 1] < 0 else None
    stack: list[int] = []
    for i, place in enumerate(tree.opens.tolist()):
        while len(stack) >= int(tree.excess[place]):
            stack.pop()
        if stack:
            children[stack[-1]] += born[i]
        stack.append(i)
    for i, place in enumerate(tree.opens.tolist()):
        close = tree.findclose(place)
        leaves = int(tree.pairs[close] - tree.pairs[place])
        if unfinished is not None and place <= unfinished < close:
            leaves -= 1
        below = tree.rank_open(close)
        yield (*chains[i], int(children[i]), leaves, int(total[below] - total[i]))


def _turn_hash(depth: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), depth, "a", "b").cast("decimal(20,0)")


def _ordered_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id``, place from 1, two hashes and the length of each turn."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    slim = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.md5(F.concat(F.md5(role), F.md5(text))).alias("tie"), F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), text, role).alias("b"), F.length(text).cast("long").alias("len"),
        F.monotonically_increasing_id().alias("_row"), F.lit(1).alias("one"))
    placed = running(staged(slim), ["conv_id"], [F.col("turn").asc_nulls_first(), "tie", "_row"], {"before": "one"})
    return placed.select("conv_id", (F.col("before") + 1).cast("long").alias("place"), "a", "b", "len")


def rebuilt(turns: DataFrame, every: int = 100, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations with the number of turns taken from their base, and all turns at their new depth."""
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("own")).withColumns({
        "base": base, "h": (F.crc32(F.col("conv_id").cast("string")) % heads).cast("long")})
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < heads)).select(
        F.col("conv_id").alias("base"), "place", "a", "b", "len")
    taken = staged(convs.join(first.groupBy("base").agg(F.max("place").alias("there")), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0).cast("long"))).alias("n_base"), "own"))
    borrowed = taken.where("n_base > 0").join(first, "base").where("place <= n_base").select(
        "conv_id", F.col("place").alias("depth"), "a", "b", "len")
    rest = turns.join(taken.select("conv_id", "h", "n_base"), "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("n_base")).alias("depth"), "a", "b", "len")
    whole = taken.select("conv_id", (F.col("n_base") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("depth"))
    return whole, borrowed.unionByName(rest)


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 over the sorted ids of each chain's ending members; ids are joined in blocks by many tasks."""
    ranges = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = ends.repartitionByRange(ranges, "top", "n", "conv_id").sortWithinPartitions("top", "n", "conv_id")

    def join(rows: Iterator[dict]) -> Iterator[tuple]:
        for (top, n), members in groupby(rows, key=lambda r: (r["top"], r["n"])):
            held: list[int] = []
            for row in members:
                held.append(row["conv_id"])
                if len(held) == IDS:
                    yield top, n, held[0], ",".join(map(str, held))
                    held = []
            if held:
                yield top, n, held[0], ",".join(map(str, held))

    def digest(rows: Iterator[dict]) -> Iterator[tuple]:
        for (top, n), blocks in groupby(rows, key=lambda r: (r["top"], r["n"])):
            total, comma = hashlib.sha256(), ""
            for block in blocks:
                total.update((comma + block["ids"]).encode())
                comma = ","
            yield top, n, total.hexdigest()

    blocks = map_rows(cut, {"top": "bigint", "n": "bigint", "first": "bigint", "ids": "string"}, join, size=16)
    return map_rows(blocks.repartition("top", "n").sortWithinPartitions("top", "n", "first"),
                    {"top": "bigint", "n": "bigint", "ends_sha256": "string"}, digest)


def _subtrees(paths: DataFrame) -> DataFrame:
    """Per chain: parent's smallest member, children, leaves and savings, merged over shards."""
    ranges = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = paths.repartitionByRange(ranges, "tops").sortWithinPartitions("tops")

    def encode(rows: Iterator[dict]) -> Iterator[tuple]:
        def one(row: dict) -> tuple[list[tuple], bool]:
            path = list(zip(row["tops"], row["members"], row["saved"], row["ends"]))
            return path, path[-1][1] > path[-1][3]

        yield from shard_subtrees([one(row) for row in rows])

    values = {"top": "bigint", "n": "bigint", "parent": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved": "bigint"}
    return map_rows(cut.select("tops", "members", "saved", "ends"), values, encode).groupBy("top", "n").agg(
        F.max("parent").alias("parent"), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")))


def prefix_trie(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", every: int = 100, heads: int = HEADS) -> DataFrame:
    """Per node of the trie: smallest member, depth, parent, members, children, leaves, savings, digest of ends."""
    turns = staged(_ordered_turns(conversations, id_col, turn_col, role_col, text_col))
    whole, deep = rebuilt(turns, every, heads)
    whole = staged(whole)
    hashed = deep.withColumns({"own_a": _turn_hash(F.col("depth"), 3), "own_b": _turn_hash(F.col("depth"), 4)})
    summed = running(hashed, ["conv_id"], ["depth"], {"sum_a": "own_a", "sum_b": "own_b", "above": "len"})
    key = {f"key_{x}": F.pmod(F.col(f"sum_{x}") + F.col(f"own_{x}"), F.lit(PRIME).cast("decimal(20,0)")).cast("long")
           for x in ("a", "b")}
    ends = whole.select("conv_id", F.col("depth").alias("_last"))
    rows = staged(summed.withColumns(key).select("conv_id", "depth", "key_a", "key_b", "len", "above").join(ends, "conv_id").select(
        "conv_id", "depth", "key_a", "key_b", "len", "above", (F.col("depth") == F.col("_last")).alias("last")))

    node = ["depth", "key_a", "key_b"]
    nodes = staged(rows.groupBy(*node).agg(
        F.min("conv_id").alias("top"), F.count(F.lit(1)).alias("n"), F.sum(F.col("last").cast("long")).alias("n_ends"),
        F.max("above").alias("above")))
    zero = F.lit(0).cast("long")
    root = whole.agg(F.min("conv_id").alias("top"), F.count(F.lit(1)).alias("n"),
                     F.coalesce(F.sum((F.col("depth") == 0).cast("long")), zero).alias("n_ends")).first()
    of_root = [F.lit(root[c]).cast("long").alias(c) for c in ("top", "n", "n_ends")]
    at_root = whole.select("conv_id", zero.alias("depth"), *of_root, zero.alias("len"), (F.col("depth") == 0).alias("last"))
    placed = staged(rows.join(nodes.drop("above"), node).select(
        "conv_id", "depth", "top", "n", "n_ends", "len", "last").unionByName(at_root))

    ending = staged(placed.where("last").select("top", "n", "conv_id"))
    one = ending.groupBy("top", "n").agg(F.min("conv_id").alias("conv_id")).select("conv_id")
    chain = placed.join(one, "conv_id", "left_semi").groupBy("conv_id", "top", "n").agg(
        F.max("n_ends").alias("n_ends"), ((F.col("n") - 1) * F.sum("len")).alias("saved"))
    path = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "top", "saved", "n_ends")))
    paths = chain.groupBy("conv_id").agg(path.alias("path")).select(
        F.col("path.top").alias("tops"), F.transform("path.order", lambda n: -n).alias("members"),
        F.col("path.saved").alias("saved"), F.col("path.n_ends").alias("ends"))

    shape = staged(nodes.select("top", "n", "depth", "n_ends", "above").unionByName(
        whole.where(F.col("conv_id") == of_root[0]).select(*of_root, zero.alias("depth"), zero.alias("above"))))
    chains = shape.groupBy("top", "n").agg(F.min(F.struct("depth", "above")).alias("begin"), F.max("depth").alias("bottom"))
    known = staged(chains.join(_subtrees(paths), ["top", "n"]).join(_digests(ending), ["top", "n"], "left"))
    bottom, begins = F.col("depth") == F.col("bottom"), F.col("depth") == F.col("begin.depth")
    return shape.join(known, ["top", "n"]).select(
        F.col("top").alias("conv_id"), "depth",
        F.when(F.col("depth") == 0, F.lit(None).cast("long")).when(begins, F.col("parent")).otherwise(F.col("top")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves", (F.col("saved") - (F.col("n") - 1) * (F.col("above") - F.col("begin.above"))).cast("long").alias("saved_tokens"),
        F.when(bottom & (F.col("n_ends") > 0), F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"))
