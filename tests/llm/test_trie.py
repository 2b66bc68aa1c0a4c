"""The conversation trie against a plain version, the parentheses against a stack, and edge cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lossledger.llm.trie import IDS, Parentheses, prefix_trie, shard_subtrees
from tests.conftest import rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, n string, top int"


def plain(turns):
    own = defaultdict(list)
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(digest(role) + digest(text)), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in sorted(whole.items()):
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(cs) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(whole[c]) == len(node))
        out.append((cs[0], len(node), min(members[node[:-1]]) if node else None, len(cs), children[node], leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, turns):
    return spark.createDataFrame([(*t, 1, "x", 2) for t in turns], SCHEMA)


def corpus():
    rng = random.Random(3)
    turns = []
    for c in rng.sample(range(2000), 260) + [0, 100, 300, 700, 1000]:
        texts = [f"t{rng.randint(0, 2 if k < 6 else 40)}" * rng.randint(1, 2) for k in range(rng.randint(1, 9))]
        turns += [(c, k, rng.choice(["user", "assistant"]) if k > 6 else "user", t) for k, t in enumerate(texts)]
    for c in range(3000, 3400):  # one very common conversation
        turns += [(c, k, "user", f"same {k} é\U00010000") for k in range(8)]
    for c in range(3500, 3530):  # each a beginning of the next
        turns += [(c, k, "user", f"step {k}") for k in range(c - 3490)]
    turns += [(4000, k, "user", f"long {k}") for k in range(700)] + [(4100, k, "user", f"long {k}") for k in range(650)]
    turns += [(5000, None, "user", "no turn"), (5000, None, None, None), (5000, 1, "user", None), (5000, 1, "user", "b"),
              (5000, 1, "user", "b"), (5001, 3, None, ""), (None, 0, "user", "lost"), (-7, 0, "user", "below"), (-7, 1, "", "")]
    return turns


def test_same_as_plain(spark, settings):
    turns = corpus()
    wanted = plain(turns)
    for shuffles in ("3", "13"):
        settings(spark__sql__shuffle__partitions=shuffles)
        got = prefix_trie(table(spark, turns).repartition(4))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert {t for _, t in got.dtypes[:-1]} == {"bigint"}
        assert sorted(rows(got), key=repr) == wanted


def test_all_conversations_share_their_first_turns(spark):
    turns = [(c, k, "user", "hello" if k < 3 else f"{c}") for c in range(100, 160) for k in range(2 + c % 3)]
    assert sorted(rows(prefix_trie(table(spark, turns))), key=repr) == plain(turns)


def test_conversations_left_without_turns(spark):
    turns = [(c, 0, "user", "only turn") for c in range(201, 260)]  # their base is not there
    got = sorted(rows(prefix_trie(table(spark, turns))), key=repr)
    assert got == plain(turns) and any(r[1] == 0 and r[-1] != hashlib.sha256(b"").hexdigest() for r in got)


def test_empty_tables(spark):
    assert rows(prefix_trie(table(spark, []))) == []
    assert rows(prefix_trie(table(spark, [(None, 1, "user", "x")]))) == []


def test_ids_of_a_large_group_meet_in_blocks(spark):
    many = spark.range(10_000, 10_000 + IDS + 500).select(
        F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("turn")).withColumns(
        {"role": F.lit("user"), "text": F.col("turn").cast("string")})
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie(many).collect()}
    ends = hashlib.sha256(",".join(str(i) for i in range(10_000, 10_000 + IDS + 500)).encode()).hexdigest()
    assert got[10_000, 6]["ends_sha256"] == ends and got[10_000, 6]["n_convs"] == IDS + 500


def test_parentheses():
    rng = random.Random(1)
    for size in [0, 1, 2, 31, 32, 33, 64, 2047, 2048, 2049, 5000]:
        for deep in (0.5, 0.9, 1.0):
            steps, level, left = [], 0, size
            while left or level:
                if left and (level == 0 or rng.random() < deep):
                    steps.append(1)
                    level, left = level + 1, left - 1
                else:
                    steps.append(-1)
                    level -= 1
            tree, stack, close = Parentheses(np.array(steps, np.int8)), [], {}
            for i, s in enumerate(steps):
                if s > 0:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            for n, (place, end) in enumerate(sorted(close.items())):
                assert tree.findclose(place) == end and tree.rank_open(place) == n
                leaves = sum(steps[i] > 0 > steps[i + 1] for i in range(place, end)) if size < 100 else None
                assert leaves is None or tree.pairs[end] - tree.pairs[place] == leaves


def test_shards_add_up_wherever_they_are_cut():
    rng = random.Random(4)
    bags = [tuple(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(40)]
    members = defaultdict(list)
    for c, bag in enumerate(bags):
        for d in range(len(bag) + 1):
            members[bag[:d]].append(c)
    paths = {}
    for bag in set(bags):
        path, seen = [], set()
        for d in range(len(bag) + 1):
            chain = members[bag[:d]][0], len(members[bag[:d]])
            if chain in seen:
                path.pop()
            seen.add(chain)
            bottom = [b for b in members if (members[b][0], len(members[b])) == chain]
            path.append((*chain, 10 * chain[0] + chain[1], sum(bags[c] in bottom for c in members[bag[:d]])))
        paths[tuple(p[0] for p in path)] = (path, path[-1][1] > path[-1][3])
    ordered = [paths[k] for k in sorted(paths)]

    def total(shards):
        sums, parents = defaultdict(lambda: np.zeros(3, int)), {}
        for shard in shards:
            for top, n, parent, *values in shard_subtrees(shard):
                sums[top, n] += np.array(values)
                assert parents.setdefault((top, n), parent) == parent
        return {k: tuple(v.tolist()) for k, v in sums.items()}

    whole = total([ordered])
    assert whole[0, 40][1] == sum(not any(b != c and c[: len(b)] == b for c in set(bags)) for b in set(bags))
    for size in (1, 2, 3, 7):
        assert total([ordered[i : i + size] for i in range(0, len(ordered), size)]) == whole
