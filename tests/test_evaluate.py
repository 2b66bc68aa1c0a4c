import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lossledger.operators.evaluate import confusion_at, pr_curve, ranking_metrics
from tests.conftest import rows


def table(spark, data, partitions=4):
    return spark.createDataFrame(data, "label int, score double").repartition(partitions)


def brute_force(data):
    """Metrics by their definitions, over all pairs and all thresholds."""
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    auc = None
    if pos and neg:
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last, best = 0.0, 0.0, None
    for t in sorted({s for _, s in data}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        if pos:
            ap += (tp / len(pos) - last) * tp / (tp + fp)
            last = tp / len(pos)
        f1 = 2 * tp / (tp + fp + len(pos))
        if best is None or f1 >= best[0]:
            best = (f1, t, tp, fp)
    f1, t, tp, fp = best
    return {
        "roc_auc": auc, "pr_auc": ap, "f1": f1, "optimal_threshold": t,
        "accuracy": (tp + len(neg) - fp) / len(data),
        "recall": tp / len(pos) if pos else 0.0,
        "positive_rate": len(pos) / len(data),
    }


def check(spark, data, **options):
    got = ranking_metrics(pr_curve(table(spark, data), "label", "score", **options)).first().asDict()
    want = brute_force(data)
    for name, value in want.items():
        assert got[name] == (pytest.approx(value, abs=1e-9) if value is not None else None), name


@pytest.mark.parametrize("data", [
    [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)],
    [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)],
    [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)],
    [(0, 0.9), (0, 0.8), (1, 0.2), (1, 0.1)],
    [(1, 0.3), (1, 0.6)],
    [(0, 0.3), (0, 0.6)],
    [(1, 0.4)],
], ids=["mixed", "one score", "perfect", "inverted", "only positives", "only negatives", "one row"])
def test_small_cases(spark, data):
    check(spark, data)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12).map(lambda i: i / 8)), min_size=2, max_size=60))
def test_tied_scores(spark, data):
    check(spark, data)


@pytest.mark.parametrize("buckets", [2, 3, 16, 256, 1000])
def test_many_scores_any_number_of_ranges(spark, buckets):
    rng = random.Random(buckets)
    check(spark, [(int(rng.random() < 0.3), round(rng.random(), 3)) for _ in range(900)], buckets=buckets)


def test_curve_does_not_depend_on_partitions(spark):
    rng = random.Random(7)
    data = [(int(rng.random() < 0.4), rng.random()) for _ in range(500)]
    curves = [sorted(rows(pr_curve(table(spark, data, n), "label", "score"))) for n in (1, 3, 13)]
    assert curves[0] == curves[1] == curves[2]


def test_no_scores(spark):
    got = ranking_metrics(pr_curve(table(spark, []), "label", "score")).first()
    assert got["optimal_threshold"] == 0.5 and got["roc_auc"] is None


def test_null_scores_are_left_out(spark):
    got = ranking_metrics(pr_curve(table(spark, [(1, None), (1, 0.9), (0, 0.1)]), "label", "score")).first()
    assert got["roc_auc"] == 1.0 and got["positive_rate"] == 0.5


def test_confusion(spark):
    data = [(1, 0.9), (0, 0.5), (1, 0.5), (1, 0.2), (0, 0.1)]
    got = confusion_at(table(spark, data), "label", "score", 0.5).first().asDict()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (2, 1, 1, 1)
    assert got["accuracy"] == 0.6 and got["recall"] == pytest.approx(2 / 3) and got["f1"] == pytest.approx(2 / 3)
