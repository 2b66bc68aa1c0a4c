"""The balanced forest: bootstraps, growth against a plain version, the table of nodes, scores."""

import hashlib
import random
import tracemalloc
from math import isqrt
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lossledger.operators import forest
from lossledger.operators.features import CATEGORICAL, LABEL, NUMERIC
from tests.conftest import rows


def plain_forest(data, trees, depth, min_leaf, seed=42):
    """``{(tree, node): (feature, split, zeros, ones, rows, probability)}``, one tree and one node at a time."""
    keys, labels, x = [d[0] for d in data], np.array([d[1] for d in data]), np.array([d[2] for d in data])
    cuts = forest.cut_points(x)
    found = {}
    for tree in range(1, trees + 1):
        words = [int(hashlib.md5(f"{seed}:{(tree - 1) // 4}:{k}".encode()).hexdigest()[8 * ((tree - 1) % 4) :][:8], 16) for k in keys]
        copies = np.array([sum(w >= p for p in forest.POISSON) for w in words])
        of = [int(copies[labels == y].sum()) for y in (0, 1)]

        def purity(inside):
            a, b = (float(copies[inside & (labels == y)].sum()) / of[y] for y in (0, 1))
            return (a * a + b * b) / (a + b)

        def grow(node, inside, level):
            zeros, ones, n = int(copies[inside & (labels == 0)].sum()), int(copies[inside & (labels == 1)].sum()), int(inside.sum())
            a, b = (c / t if t else 0.0 for c, t in zip((zeros, ones), of))
            p = np.floor(b / (a + b) * 2**40) / 2**40 if a + b else 0.0
            best = None
            if level < depth and n >= 2 * min_leaf and zeros and ones:
                drawn = {int(hashlib.md5(f"{seed}:{tree}:{node}:{i}".encode()).hexdigest()[:8], 16) % x.shape[1]
                         for i in range(1, isqrt(x.shape[1]) + 1)}
                for f in sorted(drawn):
                    for c in cuts[f]:
                        left = inside & (x[:, f] <= c)
                        right = inside & ~(x[:, f] <= c)
                        if min(left.sum(), right.sum()) >= min_leaf:
                            score = purity(left) + purity(right)
                            if score > purity(inside) and (best is None or score > best[0]):
                                best = score, f, c, left, right
            found[tree, node] = (*((best[1], best[2]) if best else (None, None)), zeros, ones, n, p)
            if best:
                grow(2 * node, best[3], level + 1)
                grow(2 * node + 1, best[4], level + 1)

        grow(1, copies > 0, 0)
    return found


def sample(spark, n=400, share=0.2):
    rng = random.Random(7)
    data = []
    for i in range(n):
        x = [float(rng.randint(0, 3)), rng.random(), round(rng.random(), 1), float(i % 2), 5.0]
        data.append((f"k{i}", int(x[1] + x[0] / 4 + rng.random() / 3 < share * 3), x))
    return data, spark.createDataFrame(data, f"account_id string, {LABEL} int, x array<double>")


def test_same_as_plain(spark):
    data, table = sample(spark)
    wanted = plain_forest(data, 6, 4, 4)
    nodes = forest.fit_forest(table.repartition(5), trees=6, depth=4)
    got = {(r["tree"], r["node"]): (r["feature"], r["split"], r["zeros"], r["ones"], r["rows"], r["probability"]) for r in nodes.collect()}
    assert got == wanted and sum(v[0] is not None for v in got.values()) > 12
    assert all((r["left"], r["right"]) == ((None, None) if r["feature"] is None else (2 * r["node"], 2 * r["node"] + 1))
               for r in nodes.collect())


def test_scores_walk_the_table(spark):
    data, table = sample(spark)
    nodes = forest.fit_forest(table, trees=6, depth=4)
    tree = {(r["tree"], r["node"]): r for r in nodes.collect()}

    def plain(x):
        total = 0.0
        for t in range(1, 7):
            node = tree[t, 1]
            while node["feature"] is not None:
                node = tree[t, node["left"] if x[node["feature"]] <= node["split"] else node["right"]]
            total += node["probability"]
        return total / 6

    got = forest.walk(table.withColumn("kept", F.lit(None).cast("date")).repartition(3), nodes)
    assert got.columns == ["account_id", LABEL, "x", "kept", "churn_probability"]
    assert {r["account_id"]: r["churn_probability"] for r in got.collect()} == {k: plain(x) for k, _, x in data}


def test_both_classes_weigh_the_same_in_every_bootstrap(spark):
    data, table = sample(spark)
    totals = rows(forest.tree_totals(forest.bag(table, trees=40)).orderBy("tree"))
    assert len(totals) == 40 and len({t[1:] for t in totals}) > 30
    for _, zeros, ones, n in totals:
        assert (zeros + ones) / (2 * zeros) * zeros == pytest.approx((zeros + ones) / (2 * ones) * ones)
        assert 0.5 * len(data) < n < 0.76 * len(data) and abs(zeros + ones - len(data)) < 100
    nodes = forest.fit_forest(table, trees=10, depth=3)
    roots = {r["tree"]: r for r in nodes.where("node = 1").collect()}
    assert all(r["probability"] == 0.5 for r in roots.values())
    for t, r in roots.items():
        leaves = nodes.where((F.col("tree") == t) & F.col("feature").isNull()).agg(F.sum("zeros"), F.sum("ones"), F.sum("rows")).first()
        assert tuple(leaves) == (r["zeros"], r["ones"], r["rows"])


def test_copies_follow_a_poisson_law():
    copies = forest.bootstrap_counts([f"a{i}" for i in range(3000)], 10, 1)
    shares = np.bincount(copies.ravel(), minlength=6)[:4] / copies.size
    assert copies.shape == (3000, 10) and shares == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.012)
    assert np.abs(np.corrcoef(copies.T) - np.eye(10)).max() < 0.08


def test_forest_does_not_depend_on_row_order(spark):
    data, table = sample(spark)
    one, other = (sorted(rows(forest.fit_forest(table.repartition(n), trees=5, depth=5)), key=repr) for n in (1, 7))
    assert one == other


def test_one_class_no_rows_and_missing_labels(spark):
    _, table = sample(spark, 30)
    alone = forest.fit_forest(table.withColumn(LABEL, F.lit(0)), trees=3)
    assert [(r["node"], r["probability"]) for r in alone.collect()] == [(1, 0.0)] * 3
    empty = forest.fit_forest(table.withColumn(LABEL, F.lit(None).cast("int")), trees=3)
    assert [(r["node"], r["rows"]) for r in empty.collect()] == [(1, 0)] * 3
    assert {r["churn_probability"] for r in forest.walk(table, empty).collect()} == {0.0}
    assert rows(forest.walk(table.limit(0), alone)) == []


def test_learns_and_reloads(spark, tmp_path):
    rng = random.Random(3)
    data = []
    for i in range(900):
        projects = rng.random() * 10
        numbers = [projects if c == "avg_projects_created" else rng.random() for c in NUMERIC]
        data.append((f"a{i}", *(rng.choice(["x", "y", None]) for _ in CATEGORICAL), *numbers, int(projects < 1.5)))
    table = spark.createDataFrame(data, ", ".join(
        ["account_id string", *(f"{c} string" for c in CATEGORICAL), *(f"{c} double" for c in NUMERIC), f"{LABEL} int"])).cache()
    trained = forest.train(table, trees=30)
    metrics = trained.metrics.first().asDict()
    assert metrics["roc_auc"] > 0.95 and metrics["f1"] > 0.8 and metrics["positive_rate"] == pytest.approx(0.15, abs=0.03)
    trained.model.save(str(tmp_path / "model"))
    again = forest.ForestModel.load(spark, str(tmp_path / "model"))
    pick = ["account_id", "churn_probability"]
    first = sorted(rows(forest.score(trained.model, table).select(pick)))
    assert first == sorted(rows(forest.score(again, table).select(pick))) and len(first) == 900
    assert forest.score(again, table).columns == [*table.columns, "churn_probability"]


class Taken:
    """Stands for a table: gives the function of a task back."""

    def mapInArrow(self, function, _schema):
        return function


def test_a_task_does_not_hold_the_counts_of_all_trees():
    trees, level, rng = 300, 6, np.random.default_rng(1)
    keys, bins = [str(i) for i in range(20_000)], rng.integers(0, 32, (20_000, 30), np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rng.integers(0, 2, 20_000, np.int32)), pa.array(list(bins))],
                                       names=["key", "label", "bins"])
    drawn = list(forest.bootstraps(Taken(), trees, 1)(iter([batch])))
    growing = forest._Growing(trees, level)
    growing.feature[:, 1 : 2**level] = rng.integers(0, 30, (trees, 2**level - 1))
    growing.bin[:] = 15
    nodes = {t: {n: [1, 5, 9, 20, 28] for n in range(2**level, 2 ** (level + 1))} for t in range(trees)}
    count = forest._histograms(Taken(), SimpleNamespace(value=growing), SimpleNamespace(value=nodes), level)
    tracemalloc.start()
    cells = most = 0
    for sent in count(iter(drawn)):
        cells, most = cells + sent.num_rows, max(most, sent.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cells > 2_000_000 and most < 200_000 and peak < 60 << 20


def test_totals_copy_no_table_of_copies(spark):
    trees, rows_ = 300, 50_000
    copies = np.random.default_rng(2).poisson(1, (rows_, trees)).astype(np.uint8)
    label = (np.arange(rows_) % 3 == 0).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(label), forest._bytes(np.zeros((rows_, 4))), forest._bytes(copies)],
                                       names=["label", "bins", "copies"])
    got = []

    class Counted(Taken):
        def mapInArrow(self, function, _schema):
            tracemalloc.start()
            got.extend(function(iter([batch])))
            got.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            return SimpleNamespace(groupBy=lambda _: SimpleNamespace(agg=lambda *_: None))

    forest.tree_totals(Counted())
    *sent, peak = got
    assert sent[0].column("all_zeros").to_pylist() == copies[label == 0].sum(axis=0).tolist()
    assert sent[0].column("all_ones").to_pylist() == copies[label == 1].sum(axis=0).tolist()
    assert sent[0].column("all_rows").to_pylist() == (copies > 0).sum(axis=0).tolist()
    assert peak < 2 * copies.size


def test_walk_ends_at_leaves_of_any_depth(spark):
    """Short trees, and a value that is no number in a row that ends early."""
    nodes = spark.createDataFrame([(1, 1, 0, 0.5, 2, 3, 0, 0, 0, 0.0), (1, 2, None, None, None, None, 0, 0, 0, 0.25),
                                   (1, 3, 1, 2.0, 6, 7, 0, 0, 0, 0.0), (1, 6, None, None, None, None, 0, 0, 0, 0.5),
                                   (1, 7, None, None, None, None, 0, 0, 0, 1.0), (2, 1, None, None, None, None, 0, 0, 0, 0.125)], forest.NODES)
    table = spark.createDataFrame([(0, [0.0, float("nan")]), (1, [1.0, 2.0]), (2, [1.0, float("nan")]), (3, [float("nan"), 9.0])],
                                  "i int, x array<double>")
    assert [r["churn_probability"] for r in forest.walk(table, nodes).orderBy("i").collect()] == [0.1875, 0.3125, 0.5625, 0.5625]
