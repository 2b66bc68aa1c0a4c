"""The subsequence kernel against a plain enumeration; long strings; the toxicity filter's edge cases."""

import random
from itertools import combinations
from math import sqrt

import pytest

from lossledger.llm import toxicity
from lossledger.llm.toxicity import DECAY, LONGEST, REACH, kernel, train, without_toxic
from tests.conftest import rows


def weights(word, size):
    """Each subsequence of ``size`` letters within its reach, weighted by how far it is spread."""
    found = {}
    for at in combinations(range(len(word)), size):
        if at[-1] - at[0] < REACH[size]:
            key = "".join(word[i] for i in at)
            found[key] = found.get(key, 0.0) + DECAY ** (at[-1] - at[0] + 1)
    norm = sqrt(sum(DECAY ** (2 * (at[-1] - at[0] + 1)) for at in combinations(range(len(word)), size) if at[-1] - at[0] < REACH[size]))
    return {k: v / norm for k, v in found.items()}


def plain_kernel(one, other):
    total = 0.0
    for size in REACH:
        a, b = weights(one, size) if len(one) >= size else {}, weights(other, size) if len(other) >= size else {}
        total += sum(a[k] * b.get(k, 0.0) for k in a)
    return total / len(REACH)


def test_kernel_is_the_sum_over_shared_subsequences():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, LONGEST))) for _ in range(40)] + ["", "idiot", "i-d".replace("-", "x"), "idioot"]
    landmarks = words[5:20] + ["idiot"]
    got = kernel(words, landmarks)
    for i, word in enumerate(words):
        for j, landmark in enumerate(landmarks):
            assert got[i, j] == pytest.approx(plain_kernel(word, landmark), abs=1e-12)


def test_long_strings_are_learned_by_their_tails():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    heads, insults, tails, words = ([make(n) for _ in range(k)] for n, k in ((LONGEST, 12), (7, 6), (7, 60), (6, 400)))
    documents = []
    for i in range(900):
        toxic = int(i % 5 == 0)
        long = [rng.choice(heads) + rng.choice(insults if toxic else tails) for _ in range(2)]
        documents.append((toxic, rng.sample(words, 30) + long))
    machine = train(documents, 0.2)

    def score(bag):
        return machine.probability(*toxicity.document_features(machine.decide_raw(bag).tolist()))

    predicted = [(label, score(bag) >= 0.7) for label, bag in documents]
    assert sum(p for label, p in predicted if label) >= 0.9 * 180
    assert sum(p for label, p in predicted if not label) <= 0.02 * 720


def test_filter_keeps_columns_and_rows_without_text(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 10))) for _ in range(300)]
    told = lambda i: " ".join(rng.sample(words, 12) + ["xyzzyfool"] * (i % 4 == 0))
    docs = [(i, told(i), i, "p") for i in range(400)]
    docs += [(1000, None, 1, "p"), (1001, "", 2, "p"), (None, "nobody", 3, "p"), (None, None, None, None), (1, "a kind word again", 5, "p")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, score int, predicted string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    kept = without_toxic(table, labels)
    assert kept.schema == table.schema
    assert sorted(rows(kept), key=repr) == sorted([d for d in docs if "xyzzyfool" not in (d[1] or "")], key=repr)
    assert rows(without_toxic(table.limit(0), labels)) == []
    assert kept.count() == without_toxic(table.repartition(7), labels).count()
