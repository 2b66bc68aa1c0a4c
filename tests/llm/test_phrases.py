"""Collocations against a plain version, exact scores, and edge cases."""

import random
import re
from collections import Counter, defaultdict

from lossledger.llm import phrases
from lossledger.llm.phrases import collocations, scored
from tests.conftest import rows

SCHEMA = "doc_id bigint, text string, lang string, a int, score string, rank int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least=30, top=2000, percent=80):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[p : p + k]) for p in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        listed = []
        for p, a in found.items():
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                       for q, b in found.items()):
                listed.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = ["a", "B", "c", "dé", "É", "e f", "\U00010000", "", "x\x01", "\x00"]
    docs = []
    for i in range(150):
        text = "".join(rng.choice(words[: 2 + i % 9]) + rng.choice("  \t    .,\n:;!?\r\x0b\x0c") for _ in range(rng.randint(1, 120)))
        docs.append((text, rng.choice(["en", "de", None, "und", ""])))
    docs += [("one and two and three", "en")] * 40 + [("of the people by the people", "en")] * 31
    docs += [(None, "en"), ("", "de"), (" \t ", None), ("a a a a a a a a " * 30, "fr"), ("lonely", "it")]
    return docs


def table(spark, docs):
    return spark.createDataFrame([(None if i % 9 == 0 else i, t, l, 1, "x", 2) for i, (t, l) in enumerate(docs)], SCHEMA)


def test_same_as_plain(spark):
    docs = corpus()
    got = collocations(table(spark, docs))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    wanted = plain(docs)
    assert len({w[0] for w in wanted}) >= 5 and sorted(rows(got)) == wanted


def test_lists_are_cut_after_ties_and_small_limits(spark):
    docs = corpus()
    got = sorted(rows(collocations(table(spark, docs), least=3, top=25, percent=60)))
    assert got == plain(docs, 3, 25, 60)


def test_small_slices_change_nothing(spark, monkeypatch):
    docs = corpus()
    text = docs[8][0] * 3
    fold = lambda part: [p.split() for p in part.split(phrases.BREAK) if p.split()]
    whole = [w for part in phrases.slices(text) for w in fold(part)]
    monkeypatch.setattr(phrases, "HELD", 7)
    assert len(list(phrases.slices(text))) > 5
    assert whole == [w for part in phrases.slices(text) for w in fold(part)] != []
    monkeypatch.undo()
    long = [(". ".join(t or "" for t, _ in docs) * 400, "en"), ("one and two " * 100_000, "de")]
    assert len(long[0][0]) > phrases.HELD
    assert sorted(rows(collocations(table(spark, long)))) == plain(long)


def test_full_sketches_hold_nothing_back(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FREQUENT", phrases.Sketch(depth=1, bits=16, dtype="u1", top=1))
    docs = corpus()
    assert sorted(rows(collocations(table(spark, docs), least=2))) == plain(docs, 2)


def test_runs_of_four_need_both_frequent_threes():
    class Cells:
        value = phrases.FREQUENT.empty()

    def sent(*threes):
        for three in threes:
            keys = phrases._run_keys(phrases._word_keys("en", three.encode().split()), 3)
            phrases.FREQUENT.add(Cells.value, keys)
        folded = b"a b c d\nx a b c d\na b c\nd a b\nc d"
        return [(p, int(n)) for found, counts in phrases._runs(Cells, 4)("en", phrases.Words(folded))
                for p, n in zip(found.to_pylist(), counts)]

    assert sent("a b c") == []
    assert sent("b c d") == [(b"a\nb\nc\nd", 2)]
    assert list(phrases._runs(Cells, 4)("en", phrases.Words(b"a b c"))) == []


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**18
    streams = [spark.createDataFrame([("en", p, f) for p, f in level], "lang string, phrase string, f bigint") for level in (
        [("x", big + 1), ("y", big), ("z", big)], [("x\ny", big), ("y\nz", big - 7)], [("x\ny\nz", big * 4 // 5)], [])]
    got = {r["phrase"]: r for r in scored(streams).collect()}
    assert got["x\ny"]["score"] == 2_000_000 * big // (2 * big + 1) == 999_999
    assert got["y\nz"]["score"] == 2_000_000 * (big - 7) // (2 * big)
    assert got["x\ny\nz"]["score"] == 800_000  # of both cuts after flooring: the first counts
    assert got["x\ny\nz"]["k"] == 1 and got["x\ny\nz"]["l"] == big + 1
    assert got["x\ny"]["covered"] and got["y\nz"]["covered"] and not got["x\ny\nz"]["covered"]


def test_empty_table(spark):
    assert rows(collocations(spark.createDataFrame([], SCHEMA))) == []
