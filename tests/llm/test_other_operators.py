"""Neighbours, toxicity, sharding, packing, URL filter, chat formatting and the pipeline."""

import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lossledger.llm import queries, toxicity
from lossledger.llm.neighbours import adaptive_scan, nearest, unit
from lossledger.llm.packing import TOKENIZER, WordTokens, best_fit, pack, token_pieces
from lossledger.llm.perspectives import perspectives
from lossledger.llm.sharding import communication_matrix, shard_documents
from lossledger.llm.url_filter import Rule, judge_urls
from tests.conftest import planned, rows
from tools.compare import connect, differences

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    wanted = connect(DATA).execute(queries.SQL[name])
    names = [d[0] for d in wanted.description]
    assert differences(got.columns, rows(got), names, wanted.fetchall()) is None


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((1500, 24)).tolist()
    table = [(i, v, i) for i, v in enumerate(vectors)]
    table += [(2000 + i, vectors[0], 0) for i in range(400)]  # one very common vector
    table += [(3000, None, 0), (3050, [0.0] * 24, 0), (3100, [float("nan")] + [1.0] * 23, 0), (3150, [None] + [1.0] * 23, 0),
              (3200, [1.0, 2.0], 0), (3250, [float("inf")] + [1.0] * 23, 0), (None, vectors[3], 0), (50, vectors[50], 50)]
    frame = spark.createDataFrame(table, "vec_id bigint, embedding array<float>, score int")
    got = defaultdict(list)
    for query, rank, vec, score in sorted(rows(nearest(frame))):
        assert rank == len(got[query]) + 1
        got[query].append((vec, score))
    fine = {i: np.array(v, np.float32).astype(float) for i, v, _ in table if i is not None and (i < 3000)}
    ids, matrix = np.array(list(fine)), unit(np.array(list(fine.values())))
    assert set(got) == {i for i in fine if i % 50 == 0}
    found = 0
    for query, hits in got.items():
        cosine = matrix @ unit(fine[query][None])[0]
        for vec, score in hits:
            assert vec != query and score == pytest.approx(cosine[ids == vec][0], abs=1e-9)
        order = np.lexsort((ids, -np.round(cosine, 9)))
        best = [int(i) for i in ids[order] if i != query][:5]
        found += len(set(best) & {v for v, _ in hits})
    assert found >= 0.9 * 5 * len(got)
    assert [v for v, _ in got[0]] == [2000, 2001, 2002, 2003, 2004]  # ties by id
    assert rows(nearest(frame.where("vec_id < 0"))) == []
    assert len(rows(nearest(frame.where("vec_id in (50, 51, 52)")))) == 2


def test_scan_abandons_but_keeps_the_nearest():
    rng = np.random.default_rng(1)
    rows_, query = unit(rng.standard_normal((4000, 64))), unit(rng.standard_normal((1, 64)))[0]
    alive = adaptive_scan(query, rows_, float("inf"), 5)
    best = np.argsort(((rows_ - query) ** 2).sum(axis=1))[:5]
    assert set(best) <= set(alive) and len(alive) < 1000


# toxicity


def test_toxicity(spark, documents):
    rng = random.Random(4)
    syllables = ["the", "an", "er", "ti", "on", "re", "ha", "es"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda n: [word() for _ in range(n)]
    docs, labels = [], []
    for i in range(900):
        words = prose(rng.randint(5, 60))
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "numskull", "dimwit"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    extra = [(1000, "the blxockheaxd ti on"), (1001, "re num-skull an es"), (1002, "an d i m w i t re ha"), (1003, None),
             (1004, ""), (1005, " ".join(prose(20_000))), (1006, " ".join(prose(9000)) + " dimwit"), (None, "the dimwit an")]
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 0, None)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(documents(docs + extra), known).collect()}
    for i, _, toxic in labels:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["predicted"] == toxic, i
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, None)] == [1, 1, 1, 0, 0, 0, 1, 1]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"] is False
    assert toxicity.toxicity(documents([]), known).count() == 0
    flat = toxicity.toxicity(documents(extra), known.where("doc_id < 0")).collect()
    assert {r["predicted"] for r in flat} == {0}


def test_toxicity_never_learns_from_held_out_rows(spark, documents):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = documents([(i, "dimwit the an" if i in held else "the an er") for i in range(300)])
    known = spark.createDataFrame([(i, int(i in held)) for i in range(300)], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs, known).collect()} == {0}


# sharding


def test_sharding(documents):
    table = [(i, f"text {i % 7}") for i in range(1003)] + [(None, None), (3, "text 3"), (3, "text 3")]
    for options in ({}, {"block_rows": 20}):
        got = shard_documents(documents(table), **options).collect()
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            text = dict(table)[r["doc_id"]] or ""
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (
                len(text) + 1, zlib.crc32(text.encode()), "rows", None)
        assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in table)
        assert set(slots) == set(range(16)) and {len(s) for s in slots.values()} == {62, 63}
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert abs(np.corrcoef(moved, range(len(moved)))[0, 1]) < 0.2
    assert shard_documents(documents([])).count() == 0
    assert "Python" not in planned(shard_documents(documents(table)))


def test_matrix_has_both_margins_and_is_uniform():
    drawn = np.array([communication_matrix([30, 0, 70], [50, 25, 25], seed) for seed in range(400)])
    assert (drawn.sum(axis=2) == [30, 0, 70]).all() and (drawn.sum(axis=1) == [50, 25, 25]).all()
    assert drawn[:, 0, 0].mean() == pytest.approx(15, abs=0.5)
    assert drawn[:, 0, 0].var() == pytest.approx(30 * 0.5 * 0.5 * 70 / 99, rel=0.25)


# packing


@pytest.mark.parametrize("text", [
    "", "The theory; the  THEORY.", "don't I'LL it's 12 345", "x<|endoftext|>y <|startoftext|>", "Élan ÈTRE ñandú ß ŒUVRE!!",
    "é a ́b", "İstanbul ΑΣ Σ ﬁ", "a\x1cb \x85c​d", "word... ??? $$$a b$$$", "日本語 текст", "a.b,c. .d", "ǅ ɐ ʼn"])
def test_word_tokens_equal_the_tokenizer(text):
    plain = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    tokens = WordTokens()
    assert np.frombuffer(tokens.ids(text), "<u4").tolist() == plain
    assert np.frombuffer(tokens.ids(text), "<u4").tolist() == plain  # from the cache


def test_packing(documents):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "onhare", "nting", "edsh."]) for _ in range(rng.randint(0, 900)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "the " * 5000), (402, "the " * 5000), (None, "the an")]
    got = pack(token_pieces(documents(docs), with_ids=True), group_rows=100).collect()
    text, whole = dict(docs), Tokenizer.from_file(TOKENIZER)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, parts in by_doc.items():
        ids = whole.encode(text[i] or "", add_special_tokens=False).ids + [0]
        for r in parts:
            assert r["ids"] == ids[r["start"] : r["start"] + 2048] and r["start"] == 2048 * r["piece"]
        assert len(parts) == -(-len(ids) // 2048) * sum(j == i for j, _ in docs)
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    one_group = pack(token_pieces(documents(docs)))
    total = sum(r["length"] for r in got)
    assert one_group.select("sequence_id").distinct().count() <= -(-total // 2048) + 2
    assert pack(token_pieces(documents([]))).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_holds_every_capacity(score):
    lengths = np.random.default_rng(3).integers(1, 100, 500)
    sequence, offset = best_fit(lengths, 100, 3, 4000, (1.0, 1.0, 1.0), score) if lengths.max() ** 2 <= 4000 else best_fit(
        np.minimum(lengths, 63), 100, 3, 4000, (1.0, 1.0, 1.0), score)
    lengths = np.minimum(lengths, 63)
    for s in set(sequence.tolist()):
        own = lengths[sequence == s]
        assert own.sum() <= 100 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 4000
        assert sorted(offset[sequence == s]) == sorted(np.cumsum(np.r_[0, own[np.argsort(offset[sequence == s])]])[:-1])


# URL filter


def test_url_filter(spark):
    good = [f"https://site{i}.good.com/news/article-{i}" for i in range(60)]
    bad = [f"http://xx{i}.bad.net/fr/zzqq-{i}-win" for i in range(60)]
    odd = [None, "", "no scheme", "http://A.B.COM", "http://COM/x?y=/en/", "ftp://www.example.com/en/a#b", "http://example.com/en",
           "http://example.com/en/", "http://notexample.com/en/", "http://x.net/es/1://y", "http://org.org/news/article-7",
           "http://qq.org/zzqq-9-win", "http://h/" + "a" * 30_000]
    table = [(i, u, "x", 1) for i, u in enumerate(good + bad + odd)] + [(None, odd[5], "x", 1), (0, good[0], "x", 1)]
    pages = spark.createDataFrame(table, "page_id bigint, url string, html string, rule int")
    judged = judge_urls(pages)
    assert "Python" not in planned(judged)
    got = judged.collect()
    assert len(got) == len(table)
    by_id = {r["page_id"]: r for r in got}
    at = lambda i: tuple(by_id[120 + i])[1:5]
    assert [at(i)[:3] for i in range(10)] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.b.com", "", None), ("com", "/x", "com/"),
        ("www.example.com", "/en/a", "www.example.com/en/"), ("example.com", "/en", "com/"),
        ("example.com", "/en/", "example.com/en/"), ("notexample.com", "/en/", "com/"), ("x.net", "/es/1://y", "net/es/")]
    assert [at(i)[3] for i in (4, 5, 7, 9, 10, 11)] == ["allow", "allow", "block", "block", "allow", "block"]
    assert by_id[None]["verdict"] == "allow" and {r["verdict"] for r in got} == {"allow", "block"}
    assert judge_urls(pages.limit(0)).count() == 0
    assert judge_urls(pages, rules=(Rule("nowhere", "/", "allow"),)).where("verdict IS NULL").count() == 0


# chat formatting


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo 😀"), (1, 3, "ann", None), (1, 70, None, "late"),
             (2, 0, "system", "alone"), (None, 0, "eve", "x"), (3, None, "cat", "miau"), (3, 1, "cat", "a"), (3, 1, "cat", "a")]
    frame = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id bigint, turn int, role string, text string, chunk string")
    got = {(r["conv_id"], r["chunk"], r["speaker"]): r for r in perspectives(frame).collect()}
    assert set(got) == {(1, c, s) for c in (0, 1) for s in ("ann", "bob", "unknown")} | {
        (None, 0, "eve"), (3, 0, "cat"), (3, None, "cat")}
    for (_, _, speaker), row in got.items():
        spans = [tuple(map(int, m.split(":"))) for m in row["mask"].split(",") if m]
        assert len(spans) == row["n_own"] and row["text"].count("<|end|>") == row["n_turns"]
        for start, end in spans:
            assert row["text"][:start].endswith("<|assistant|>\n") and row["text"][start:end].endswith("<|end|>")
            assert row["text"][start:end].count("<|end|>") == 1
        assert f"<|user:{speaker}|>" not in row["text"]
    assert got[1, 0, "bob"]["text"] == (
        "<|system|>\nbe kind<|end|>\n<|user:ann|>\nhi<|end|>\n<|assistant|>\nyo 😀<|end|>\n<|user:ann|>\n<|end|>\n")
    assert got[3, 0, "cat"]["n_own"] == 2 and perspectives(frame.limit(0)).count() == 0


# pipeline


def test_pipeline(spark, tmp_path):
    if not Path(DATA).exists():
        pytest.skip("driver tables are not here")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / str(len(seen)))
        stage(spark, seen[-1], DATA).write.parquet(out)
        seen.append(spark.read.parquet(out))
    ids = [sorted(r[0] for r in d.select("doc_id").collect()) for d in seen[:5]]
    assert all(d.schema == docs.schema for d in seen[1:5])
    predicted = queries.QUERIES["op4_toxicity"](spark, DATA).where("predicted = 1")
    assert ids[1] == sorted(set(ids[0]) - {r["doc_id"] for r in predicted.collect()})
    from tests.llm import plain

    texts = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    assert ids[2] == [i for i, _, c in plain.classes(texts, corpus_pipeline.NEAR_PERCENT, corpus_pipeline.NEAR_WORDS) if i == c]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = [(r["doc_id"], r["text"]) for r in seen[2].collect()]
    from lossledger.llm.decontaminate import build_tables, is_contaminated, search, words_of

    tables = build_tables(items)
    bad = {i for i, t in texts if is_contaminated(sum(e - s for s, e in search(words_of(t), tables)[0]), len(words_of(t)))}
    assert ids[3] == sorted(set(ids[2]) - bad) and ids[4] == ids[3]
    for row in seen[4].collect():
        assert plain.secrets(row["text"]) == [] or "[secret]" in row["text"]
        assert row["n_chars"] == len(row["text"])
    assert sorted({r["doc_id"] for r in seen[5].collect()}) == ids[4]


def test_a_worker_keeps_a_bounded_number_of_words(monkeypatch):
    tokens = WordTokens()
    text = "Words, plain and marked; " * 3
    ids = tokens.ids(text)
    assert ids == tokens._encode(text)
    with monkeypatch.context() as m:
        m.setattr(tokens, "_word", lambda word: b"")
        tokens.ids(" ".join(f"w{i}" for i in range(700_000)))
    assert len(tokens.young) + len(tokens.old) <= 400_000
    assert tokens.ids(text) == ids
