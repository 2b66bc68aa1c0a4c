"""Substring dedup, secret scan, decontamination and Jaccard join against plain versions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lossledger.llm import decontaminate, secrets
from lossledger.llm.decontaminate import benchmark_hits, contamination, contamination_filter
from lossledger.llm.jaccard import Threshold, jaccard_classes
from lossledger.llm.secrets import checksum, find_secrets, named, redact, redact_secrets, scan
from lossledger.llm.substrings import deduplicated
from tests.conftest import rows
from tests.llm import plain


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def changed(text, seed, edits):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    base, passage = prose(1, 300), prose(2, 70)
    docs = [(i, prose(100 + i, 20 + 7 * i)) for i in range(12)]
    docs += [(20 + i, base) for i in range(6)]
    docs += [(30 + i, changed(base, i, 1 + i)) for i in range(12)]
    docs += [(50 + i, f"{prose(300 + i, 30)} {passage} {prose(400 + i, 15)}") for i in range(6)]
    docs += [(60, None), (61, ""), (62, "one"), (63, "One"), (64, "a b"), (65, "a \t b"), (66, "   "),
             (67, "la " * 3000), (68, "la " * 3001), (69, prose(9, 9000))]
    small = [f"s{i}" for i in range(26)]
    docs += [(80, " ".join(small)), (81, " ".join(small[:-1])), (82, " ".join(small[:-1] + ["q"])),
             (83, " ".join(small[1:])), (84, " ".join(small[:12])), (85, " ".join(small[:13])), (86, " ".join(small[:14]))]
    return docs


def test_substrings(documents, corpus):
    with_nulls = [*corpus, (None, prose(1, 300)), (20, prose(1, 300))]
    for window in (50, 7):
        got = deduplicated(documents(with_nulls), window=window)
        assert sorted(rows(got), key=str) == plain.substrings(with_nulls, window)


def test_substrings_of_no_rows_and_kept_text(documents):
    assert rows(deduplicated(documents([]))) == []
    text = prose(1, 60)
    kept = deduplicated(documents([(1, text), (2, f"new {text}\nend")]), with_text=True)
    assert {r["doc_id"]: r["kept"] for r in kept.collect()} == {1: text, 2: "new end"}


def test_classes(documents, corpus):
    for percent in (90, 70):
        got = jaccard_classes(documents(corpus), percent=percent)
        assert sorted(rows(got)) == plain.classes(corpus, percent)


def test_classes_with_null_and_repeated_ids(documents):
    text = prose(5, 40)
    got = rows(jaccard_classes(documents([(5, text), (5, text), (9, text), (9, "b c d"), (7, "b c d"), (None, text)])))
    assert sorted(got, key=str) == sorted(
        [(5, 38, 5), (5, 38, 5), (9, 38, 5), (9, 1, 5), (7, 1, 5), (None, 38, None)], key=str)
    assert rows(jaccard_classes(documents([]))) == []


@given(st.integers(1, 200), st.integers(1, 200), st.integers(1, 100))
def test_bounds_lose_no_link(m, n, percent):
    limit = Threshold(percent)
    for common in range(min(m, n) + 1):
        if limit.linked(common, m, n):
            assert common >= limit.overlap(m, n) and m >= limit.least_partner(n)
            assert n - common <= limit.missing(n) and n - common < limit.prefix(n)


SECRET = "AKIA" + "Q7" * 9
BODY = "a1B2" * 7 + "zz"
CASES = ["", "no secrets here", f"password = 'abc123x' {SECRET} tail", "PassWD: hunter2x token:short",
         "secret_token=abcdef api_key=ABC/def+1", "x" * 3 + "0123456789abcdef01234567" + "g", "é" * 5 + "f" * 25,
         "deadbeef" * 40, f"ghp_{BODY}{checksum(BODY)} npm_{BODY}{checksum(BODY)}", f"ghp_{BODY}000000",
         "tokentoken=abcdefg", "toKen = abcdefgh", "AKIAAKIA" + "1" * 20, "password=" + "a" * 50_000, "ſecret=abcdefgh"]


@pytest.mark.parametrize("text", CASES)
def test_base_secrets_of(text):
    found = scan(text, secrets._automaton())
    assert [s for s in found if s[0] in ("assign", "access", "hex")] == plain.secrets(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "=", ":", " ", "'", '"', "abc123", "AKIA", "Z9" * 8, "0af3" * 7,
                                 "é", "passwd", "secret", "\n", "ghp_"]), max_size=25).map("".join))
def test_base_secrets(text):
    found = scan(text, secrets._automaton())
    assert [s for s in found if s[0] in ("assign", "access", "hex")] == plain.secrets(text)


def test_checked_tokens_and_redaction(documents):
    good, bad = f"ghp_{BODY}{checksum(BODY)}", f"ghp_{BODY}000000"
    got = {r["doc_id"]: r for r in find_secrets(documents([(1, good), (2, bad), (3, None), (3, None)])).collect()}
    assert (got[1]["n_checked"], got[2]["n_checked"], got[3]["spans"]) == (1, 0, "")
    assert got[1]["spans"] == named([("github", 0, 40)])
    assert redact("password=abcdefg and more", [("assign", 0, 16)]) == "[secret] and more"
    clean = redact_secrets(documents([(1, f"see {good}."), (2, None), (4, "clean")])).orderBy("doc_id")
    assert [r["text"] for r in clean.collect()] == ["see [secret].", None, "clean"]


def test_contamination(spark, documents):
    items = [(1, prose(7, 30)), (2, "Short, item here"), (3, None), (4, "..."), (5, prose(7, 30)), (10, "single"), (None, "x y")]
    shown = items[0][1]
    docs = [(1, f"{prose(8, 40)} {shown} {prose(9, 40)}"), (2, shown.upper()), (3, "a short ITEM here; single"), (4, None),
            (5, ""), (6, " ".join(shown.split()[:12])), (7, " ".join(shown.split()[:13])), (8, f"{prose(3, 900)} single"),
            (8, f"{prose(3, 900)} single"), (9, "x y"), (None, shown)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = plain.contamination(docs, items)
    assert sorted(rows(contamination(documents(docs), bench)), key=str) == expected
    assert sorted(rows(contamination(documents(docs), bench, max_pattern_bytes=100)), key=str) == expected
    kept = contamination_filter(documents(docs), bench)
    assert kept.columns == documents([]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in expected if not r[-1])
    assert rows(contamination(documents([]), bench)) == []
    assert all(r["starts"] == [] for r in benchmark_hits(documents(docs), bench.limit(0)).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=6))
def test_search_finds_every_occurrence(words, items):
    tables = decontaminate.build_tables([(i, " ".join(x)) for i, x in enumerate(items)], 4)
    ranges, found = decontaminate.search([w.encode() for w in words], tables)
    hit = {p for s, e in ranges for p in range(s, e)}
    expected, names = set(), set()
    for i, item in enumerate(items):
        n = min(4, len(item))
        for q in range(len(item) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == item[q : q + n]:
                    expected |= set(range(p, p + n))
                    names.add(i)
    assert (hit, found) == (expected, names)


def test_hex_runs_between_wide_letters():
    text = "".join(f"ä漢{'ab' * (12 + i % 3)}€😀 {'f' * 23}z" for i in range(50))
    found = scan(text, secrets._automaton())
    assert found == plain.secrets(text)
    assert len(found) == 50
