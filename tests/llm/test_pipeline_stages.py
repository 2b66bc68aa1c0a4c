"""Stages of the pipeline against plain versions at their own laws."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lossledger.llm import jaccard
from lossledger.llm.common import map_rows, removed_after, staged
from lossledger.llm.jaccard import MEMBERS, Threshold, _field, _unlinked, _verified
from tests.conftest import final_plan
from tests.llm import plain

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
def test_near_copies_go_at_five_words_and_80_percent(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.keep_one_of_each_class(spark, docs, DATA)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    wanted = [i for i, _, c in plain.classes(texts, 80, 5) if i == c]
    assert wanted != [i for i, _, c in plain.classes(texts, 90, 3) if i == c]
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == wanted


def test_one_row_stays_of_repeated_and_missing_ids(spark, documents):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    docs = [(1, text("a")), (1, text("a")), (1, text("a") + " near"), (1, text("b")), (2, text("b")), (3, text("c")),
            (None, text("c")), (None, text("c") + " near"), (None, text("d")), (None, text("d")), (None, text("e")),
            (4, None), (4, None), (4, ""), (5, ""), (None, None), (None, None)]
    kept = corpus_pipeline.keep_one_of_each_class(spark, documents(docs), "")
    assert kept.columns == documents([]).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([
        (1, text("a")), (1, text("b")), (3, text("c")), (None, text("d")), (None, text("e")),
        (4, None), (4, ""), (5, ""), (None, None), (None, None)], key=str)


def test_other_columns_may_have_any_name(spark, documents):
    names = ["_row", "_ROW__", "_class", "_id", "_text", "component_id", "n_shingles", "no_id", "first"]
    text = " ".join(f"a{i}" for i in range(60))
    docs = documents([(1, text), (2, text), (3, "other words than those")])
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    kept = corpus_pipeline.keep_one_of_each_class(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.asDict()["component_id"] for r in kept.collect()) == ["component_id1", "component_id3"]


EDGES = [(1, None), (2, ""), (2, ""), (None, "plain words"), (3, " \t\n"), (3, "a plain line"), (4, "long " * 30_000)]


@pytest.fixture
def tables(spark, tmp_path):
    """Labels and a benchmark that mark none of the edge cases."""
    marked = [(10, "an odd plonker sat"), (11, "that plonker again"), (12, "some calm words")]
    spark.createDataFrame(marked, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 1), (11, 1, 1), (12, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20))), (2, None), (3, "")], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, stage", [s for s in corpus_pipeline.STAGES if s[0] in ("toxicity", "decontamination", "secret_scan")])
def test_filters_keep_null_empty_long_and_repeated_rows(spark, documents, tables, name, stage):
    docs = documents(EDGES).withColumn("score", F.lit(7)).withColumn("predicted", F.lit("x")).withColumn("spans", F.lit(None))
    got = stage(spark, docs, tables)
    assert got.schema.names == docs.schema.names
    key = lambda r: (r["doc_id"] or 0, r["text"] or "", r["text"] is None, r["score"], r["predicted"])
    assert sorted(map(key, got.collect())) == sorted(map(key, docs.collect()))
    assert stage(spark, docs.where("false"), tables).collect() == []


def test_packing_of_null_empty_long_and_repeated_rows(spark, documents, tables):
    docs = documents(EDGES).withColumn("sequence_id", F.lit("x"))
    got = corpus_pipeline.pack_sequences(spark, docs, tables).collect()
    assert sum(r["piece"] == 0 for r in got) == len(EDGES)
    assert [r["length"] for r in got if r["doc_id"] == 1] == [1]  # its end mark alone
    assert corpus_pipeline.pack_sequences(spark, docs.where("false"), tables).collect() == []


def test_stored_steps_are_removed(spark):
    with removed_after(spark):
        kept, gone = staged(spark.range(5), keep=True), staged(spark.range(6))
        with removed_after(spark):
            inner = staged(spark.range(7))
        assert gone.count() == 6
    assert kept.count() == 5
    outside = staged(spark.range(3))
    with removed_after(spark):
        pass
    assert outside.count() == 3
    for frame in (gone, inner):
        with pytest.raises(Exception, match="(?i)not exist|not_exist|FILE"):
            frame.collect()


def test_texts_stay_where_they_are_when_copies_go(spark, documents, settings):
    """Enough rows go that their numbers are not sent to all tasks; the rows of the result meet no shuffle."""
    docs = documents([(i, " ".join(f"w{i % 1000}x{j}" for j in range(8))) for i in range(6000)] + [(None, None), (7, None)])
    settings(spark__sql__autoBroadcastJoinThreshold="20k")
    kept = corpus_pipeline.keep_one_of_each_class(spark, docs, "")
    assert "SortMergeJoin" not in final_plan(kept)
    ids = sorted(r["doc_id"] for r in kept.where("text IS NOT NULL").select("doc_id").collect())
    assert ids == list(range(1000)) and kept.count() == 1002


def test_members_pass_and_few_others(spark):
    members = spark.createDataFrame([(5,), (-3,), (1 << 40,), (5,)], "id bigint")
    numbers = spark.createDataFrame([(i,) for i in range(-500, 500)] + [(1 << 40,), (None,)], "id bigint")
    passed = {r["id"] for r in numbers.where(MEMBERS.may_hold(members, "id")).collect()}
    assert passed >= {5, -3, 1 << 40} and len(passed) < 8
    assert numbers.where(MEMBERS.may_hold(members.limit(0), "id")).collect() == []


def test_pairs_are_tested_by_whole_texts(spark, documents):
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    docs = documents([(1, text(100)), (2, text(91)), (3, text(89)), (4, None), (1, None)])
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 4)], "a bigint, b bigint")
    assert sorted(map(tuple, _verified(pairs, docs, 3, Threshold(90)).collect())) == [(1, 2), (2, 3)]


def test_short_fields_keep_every_pair_that_may_be_linked(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400, dtype="u8")
    several = [np.unique(np.r_[base[cut:], rng.integers(0, 1 << 63, cut, dtype="u8")]) for cut in (0, 10, 20, 200)]
    sets = spark.createDataFrame([(i, len(e), bytearray(_field(e))) for i, e in enumerate(several)], "doc_id bigint, n int, field binary")
    lists = sets.selectExpr("9L as element", "doc_id", "n", "doc_id as class", "2 as blocks")
    got = {tuple(r) for r in _unlinked(lists, sets, 0, Threshold(80)).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)}


def test_pairs_of_many_lists_leave_them_a_few_times(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype="u8")
    several = [np.unique(np.r_[np.delete(base, rng.choice(400, 5, replace=False)), rng.integers(0, 1 << 63, 5, dtype="u8")])
               for _ in range(12)]
    sets = spark.createDataFrame([(i, len(e), bytearray(_field(e))) for i, e in enumerate(several)], "doc_id bigint, n int, field binary")
    held = {element: [i for i in range(12) if rng.random() < 0.7] for element in range(-30, 30)}
    lists = spark.createDataFrame([(e, i, len(several[i]), i, 1 + abs(e) % 2) for e, ids in held.items() for i in ids],
                                  "element bigint, doc_id bigint, n int, class bigint, blocks int")
    sent = []
    monkeypatch.setattr(jaccard, "map_rows", lambda *a, **k: sent.append(map_rows(*a, **k)) or sent[-1])
    got = {tuple(sorted(r)) for r in _unlinked(lists, sets, 0, Threshold(80)).collect()}
    assert got == {(a, b) for b in range(12) for a in range(b)}
    assert sum(len(ids) * (len(ids) - 1) // 2 for ids in held.values()) > 1500
    assert sent[-1].count() < 3 * len(got)


def test_near_copies_are_one_class_after_a_few_of_their_pairs(spark, documents, monkeypatch):
    """The smallest id of their lists is linked with none of them, so the stars join nothing."""
    rng = np.random.default_rng(6)
    group, frequent = range(1, 61), [f"c{i}" for i in range(60)]
    base = [f"w{i}" for i in range(40)] + frequent
    copies = {i: [*base[:at], f"x{i}", f"y{i}", *base[at + 2:]] for i, at in zip(group, rng.integers(42, 98, len(group)).tolist())}
    texts = {0: base[:42] + frequent[:1:-1], 99: [w for w in frequent for _ in range(300)]} | copies
    pairs = [(i, " ".join(words)) for i, words in texts.items()]
    tested = []
    monkeypatch.setattr(jaccard, "_possible", lambda pairs, *a, f=jaccard._possible: tested.append(pairs.count()) or f(pairs, *a))
    got = jaccard.jaccard_classes(documents(pairs), percent=80)
    assert sorted(map(tuple, got.collect())) == plain.classes(pairs, 80)
    assert {r["component_id"] for r in got.where(F.col("doc_id").isin(list(group))).collect()} == {1}
    assert tested[0] == len(group) and sum(tested) < 10 * len(group) < len(group) * (len(group) - 1) // 2


def test_lists_say_that_they_hold_pairs_back(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 400, dtype="u8")
    several = [np.unique(np.r_[base[2 * i:], rng.integers(0, 1 << 63, 2 * i, dtype="u8")]) for i in range(6)]
    sets = spark.createDataFrame([(i, len(e), bytearray(_field(e))) for i, e in enumerate(several)], "doc_id bigint, n int, field binary")
    lists = sets.selectExpr("explode(array(9L, if(doc_id < 3, 8L, 7L))) as element", "doc_id", "n", "doc_id as class", "1 as blocks")
    every = {(a, b) for b in range(6) for a in range(b)}
    for most, back in ((1, {7, 8, 9}), (2, {9}), (5, set()), (None, set())):
        got = [tuple(r) for r in _unlinked(lists, sets, 0, Threshold(80), most).collect()]
        assert {a for a, b in got if b is None} == back
        sent = {r for r in got if r[1] is not None}
        assert sent <= every and (back or sent == every)
        # each of the five that are not the smallest sends one at least, and no more than ``most`` from a list
        assert 5 <= len(sent) <= 2 * 5 * (most or 5)
