"""Source mixing against a plain version, its law, and edge cases."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lossledger.llm.mixing import mix, mixed, source_targets
from lossledger.llm.ordered import running
from tests.conftest import rows

SCHEMA = "doc_id bigint, text string, source string, size int, target string, _row int, place int"
UNIT = 1 << 40


def plain_targets(sizes):
    """Targets by source, exact fractions: fill up, cap, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        share = {s: Fraction(left - sum(capped.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: Fraction(3 * sizes[s]) for s in over}


def plain(docs):
    words = [(i, t, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in docs]
    sizes = Counter()
    for _, _, s, n in words:
        sizes[s] += n
    targets, out = plain_targets(sizes), []
    by_source = defaultdict(list)
    for i, t, s, n in words:
        place = hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()
        by_source[s].append((n, place, i))
    for s, members in by_source.items():
        target = float(targets[s])
        step = int(min(target / sizes[s], 3.0) * UNIT) if sizes[s] else 0
        at = int(hashlib.md5(f"11:{s or ''}".encode()).hexdigest()[:10], 16)
        for n, _, i in sorted(members, key=lambda m: m[:2]):
            copies = (at + step) // UNIT - at // UNIT
            at += step
            out.append((i, n, sizes[s], target, copies * n, copies))
    return sorted(out, key=repr)


def table(docs):
    return [(i, t, s, 7, "x", 1, 2) for i, t, s in docs]


def corpus():
    docs = [(i, "w " * (i * 37 % 200), f"s{i % 7}" if i % 3 else "hot") for i in range(900)]
    docs += [(1000 + i, "rare words here", "tiny") for i in range(2)]
    docs += [(2000, None, "s1"), (2001, "", "s1"), (2002, " \t\n\x0b\f\r ", "s1"), (2003, "a b c d", "s1"),
             (None, "no id", "s2"), (None, None, None), (3000, "of no source", None), (3001, "x " * 5000, None),
             (3002, "", ""), (3003, "\U00010000", "\U00010000"), (3004, None, "empty")]
    return docs + [(5, "again", "s5")] * 50


def test_same_as_plain(spark):
    docs = corpus()
    got = mix(spark.createDataFrame(table(docs), SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "double", "bigint", "bigint"]
    assert sorted(rows(got), key=repr) == plain(docs)


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    docs = corpus()
    frame = spark.createDataFrame(table(docs), SCHEMA)
    first, second = (sorted(rows(mix(frame.repartition(n))), key=repr) for n in (3, 11))
    assert first == second
    taken, target, largest = Counter(), {}, Counter()
    for _, size, of, wanted, n, copies in first:
        assert n == copies * size <= 3 * size
        taken[of, wanted] += n
        largest[of, wanted] = max(largest[of, wanted], size)
    for of, wanted in taken:
        assert abs(taken[of, wanted] - wanted) <= 3 * largest[of, wanted]
        assert wanted <= 3 * of


def test_targets_stop_at_three_times_the_source(spark):
    sizes = {"a": 10, "b": 10, "c": 1000, "d": 1, "e": 0, None: 4000}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in source_targets(frame).collect()}
    assert got == {s: float(t) for s, t in plain_targets(sizes).items()}
    assert got["a"] == 30 and got["e"] == 0 and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_whole_rows_of_the_mix(spark):
    docs = corpus()
    frame = spark.createDataFrame(table(docs), SCHEMA)
    copies = Counter()
    for i, n, *_, c in plain(docs):
        copies[i, n] += c
    got = mixed(frame)
    assert got.schema == frame.schema
    found = Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in got.collect())
    assert found == +copies


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(mix(empty)) == [] and rows(mixed(empty)) == []
    wordless = spark.createDataFrame(table([(1, None, "a"), (2, "", None)]), SCHEMA)
    assert sorted(rows(mix(wordless))) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]


def test_running_sums_of_a_hot_group_are_spread(spark, settings):
    settings(spark__sql__shuffle__partitions="16")
    frame = spark.range(4000).select(F.when(F.col("id") < 3000, 0).when(F.col("id") < 3990, F.col("id")).alias("g"),
                                     (F.col("id") % 50).alias("o"), "id", F.lit(2**40).cast("decimal(20,0)").alias("v"))
    got = running(frame, ["g"], ["o", "id"], {"sum": "v"})
    wanted, seen = [], Counter()
    for g, o, i in sorted(((r["g"], r["o"], r["id"]) for r in frame.collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:])):
        wanted.append((g, o, i, seen[g]))
        seen[g] += 2**40
    assert sorted(((g, o, i, int(s)) for g, o, i, _, s in rows(got)), key=repr) == sorted(wanted, key=repr)
    cut = [len(p) for p in frame.repartitionByRange(16, "g", "o", "id").rdd.glom().collect()]
    assert max(cut) < 1000
