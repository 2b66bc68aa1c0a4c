"""A forest of balanced bootstraps, grown level by level, and kept as a table of nodes.

Every tree sees each row as often as a Poisson draw says (a bootstrap that needs no exchange), and weighs the
two classes of its own bootstrap equally: all counts are divided by the class's total in that tree. All
trees grow together. For each level, tasks add up class counts by tree, node, drawn feature and bin of
the feature; the sums meet in one aggregation; running totals over the bins give every split and its
purity. What reaches the driver is the best split of each node, at most ``trees * 2 ** depth`` rows for
the whole forest, and a sample of ``CUT_SAMPLE`` rows that sets the bins.

Draws of rows and features come from digests and counts are whole numbers, so the forest depends on the
rows alone, not on their order or place. Leaf probabilities are multiples of 2 ** -40, which makes their
sum over trees exact.

Defined results: a row without an id draws as an empty one; a row without a label is not learned from;
missing features must be filled before; without rows, or with one class only, every tree is one leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, factorial, isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lossledger.operators.evaluate import pr_curve, ranking_metrics
from lossledger.operators.features import CATEGORICAL, LABEL, NUMERIC
from lossledger.operators.model import MAX_DEPTH, MIN_LEAF, TREES, preprocessing, with_holdout
from lossledger.session import stage
from lossledger.settings import SEED

BINS = 32
CUT_SAMPLE = 10_000  # rows that set the bins
CHUNK = 262_144  # rows a task counts at once
SENT = 65_536  # counts a task holds before they leave it
GRID = float(1 << 40)  # leaf probabilities are multiples of its reciprocal
#: Limits of a uniform 32-bit number for 0, 1, 2, ... copies of a row: the Poisson distribution of mean 1.
POISSON = tuple(int(2**32 * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(12))

NODES = ("tree int, node int, feature int, split double, left int, right int, zeros bigint, ones bigint, rows bigint, "
         "probability double")


def bootstrap_counts(keys: list[str | None], trees: int, seed: int) -> np.ndarray:
    """How often each tree sees each row (rows by trees); one digest serves four trees."""
    blocks = range(-(-trees // 4))
    digests = b"".join(hashlib.md5(f"{seed}:{block}:{'' if key is None else key}".encode()).digest() for key in keys for block in blocks)
    numbers = np.frombuffer(digests, ">u4").reshape(len(keys), 4 * len(blocks))[:, :trees]
    return np.searchsorted(np.array(POISSON), numbers.astype(np.int64), side="right")


def _bytes(matrix: np.ndarray) -> pa.Array:
    """One binary value per row: its small numbers, a byte each."""
    rows, width = matrix.shape
    ends = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(matrix.astype(np.uint8).tobytes())])


def bootstraps(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """``label, bins, copies`` from rows with ``key, label, bins``; bins and copies as bytes, one each."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                copies = bootstrap_counts(part.column("key").to_pylist(), trees, seed)
                yield pa.RecordBatch.from_arrays([part.column("label"), _bytes(_matrix(part.column("bins"))), _bytes(copies)],
                                                 names=["label", "bins", "copies"])

    return rows.mapInArrow(draw, "label int, bins binary, copies binary")


def drawn_features(tree: int, node: int, features: int, seed: int) -> list[int]:
    """Root of ``features`` draws; a feature drawn twice counts once."""
    digests = (hashlib.md5(f"{seed}:{tree}:{node}:{i}".encode()).hexdigest() for i in range(1, isqrt(features) + 1))
    return sorted({int(d[:8], 16) % features for d in digests})


def cut_points(values: np.ndarray) -> list[list[float]]:
    """Per column of a sample: values at which it may be split, ``x <= value`` going left."""
    cuts = []
    for column in np.sort(values, axis=0).T:
        kinds = np.unique(column)
        if len(kinds) > BINS:
            kinds = np.unique(np.r_[column[np.arange(1, BINS) * len(column) // BINS], column[-1:]])
        cuts.append(kinds[:-1].tolist())
    return cuts


def _binned(features: Column, cuts: list[list[float]]) -> Column:
    literal = F.array(*[F.array(*[F.lit(c) for c in column]).cast("array<double>") for column in cuts])
    return F.zip_with(features, literal, lambda x, c: F.size(F.filter(c, lambda q: q < x)))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, bins (features by rows) and copies (trees by rows) of up to CHUNK rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK // 8):
            held.append(batch.slice(start, CHUNK // 8))
            count += held[-1].num_rows
            if count > CHUNK - CHUNK // 8:
                yield _arrays(held)
                held, count = [], 0
    if held:
        yield _arrays(held)


def _arrays(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def across(name: str) -> np.ndarray:
        found = np.empty((len(held[0].column(name)[0].as_py()), sum(b.num_rows for b in held)), np.uint8)
        start = 0
        for batch in held:
            column = batch.column(name)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
            values = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            found[:, start : start + len(column)] = values.reshape(len(column), -1).T if len(found) else 0
            start += len(column)
        return found

    return np.concatenate([b.column("label").to_numpy() for b in held]), across("bins"), across("copies")


class _Growing:
    """The forest so far: for each tree and node (1 the root, 2n and 2n + 1 its children) the split, or -1."""

    def __init__(self, trees: int, depth: int):
        self.feature = np.full((trees, 2 ** (depth + 1)), -1, np.int16)
        self.bin = np.zeros((trees, 2 ** (depth + 1)), np.int16)

    def place(self, tree: int, inside: np.ndarray, bins: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``inside`` that come as far as ``level`` splits, and the nodes they come to."""
        node, flat, width = np.ones(len(inside), np.int64), bins.ravel(), bins.shape[1]
        of, at = self.feature[tree].astype(np.int64), self.bin[tree]
        for _ in range(level):
            feature = of[node]
            on = np.flatnonzero(feature >= 0)
            if len(on) < len(node):
                inside, node, feature = inside[on], node[on], feature[on]
            node = 2 * node + (flat[feature * width + inside] > at[node])
        return inside, node


def _histograms(sampled: DataFrame, growing, drawn, level: int) -> DataFrame:
    """Class counts and rows by tree, node, drawn feature and bin, for the nodes of ``drawn``.

    What a task holds is one chunk of rows and the counts of a few trees, which leave it as they come.
    """
    names = ["tree", "node", "feature", "bin", "zeros", "ones", "rows"]

    def together(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(column)) for column in zip(*found)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, bins, copies in _chunks(batches):
            flat, width = bins.ravel(), bins.shape[1]
            # Ones are counted in the same sum as zeros, above them: no sum of a chunk reaches 2 ** 24.
            unit = np.where(label == 1, float(1 << 24), 1.0)
            found: list[tuple[np.ndarray, ...]] = []
            for tree, nodes in drawn.value.items():
                inside, place = growing.value.place(tree, np.flatnonzero(copies[tree]), bins, level)
                order = np.full(2 ** (level + 1), -1, np.int64)
                order[list(nodes)] = np.arange(len(nodes))
                place = order[place]
                inside, place = inside[place >= 0], place[place >= 0]
                weight = copies[tree][inside] * unit[inside]
                numbers, chosen = np.array(list(nodes), np.int32), np.full((len(nodes), max(map(len, nodes.values()))), -1)
                for i, features in enumerate(nodes.values()):
                    chosen[i, : len(features)] = features
                for slot in range(chosen.shape[1]):
                    feature = chosen[:, slot][place]
                    at, start, w = inside, place * BINS, weight
                    if (chosen[:, slot] < 0).any():
                        has = feature >= 0
                        feature, at, start, w = feature[has], at[has], start[has], w[has]
                    code = start + flat[feature * width + at]
                    rows = np.bincount(code, minlength=len(nodes) * BINS)
                    cells = np.flatnonzero(rows)
                    sums = np.bincount(code, w, len(nodes) * BINS)[cells].astype(np.int64)
                    of = cells // BINS
                    found.append((np.full(len(cells), tree + 1, np.int32), numbers[of], chosen[of, slot].astype(np.int32),
                                  (cells % BINS).astype(np.int32), sums & (1 << 24) - 1, sums >> 24, rows[cells]))
                if sum(len(f[0]) for f in found) >= SENT:
                    yield together(found)
                    found = []
            if found:
                yield together(found)

    return sampled.mapInArrow(count, "tree int, node int, feature int, bin int, zeros bigint, ones bigint, rows bigint")


def purity(zeros: Column, ones: Column, all_zeros: Column, all_ones: Column) -> Column:
    """Sum of squared class shares over their sum, with classes weighed equally in the tree."""
    a, b = zeros / all_zeros, ones / all_ones
    return (a * a + b * b) / (a + b)


def best_splits(histograms: DataFrame, totals: DataFrame, min_leaf: int) -> DataFrame:
    """Per tree and node the purest split that leaves ``min_leaf`` rows on both sides, if it gains anything."""
    counted = ["zeros", "ones", "rows"]
    sums = histograms.groupBy("tree", "node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in counted))
    whole = Window.partitionBy("tree", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = sums.select("tree", "node", "feature", "bin", *(F.sum(c).over(upto).alias(f"l_{c}") for c in counted),
                         *(F.sum(c).over(whole).alias(c) for c in counted)).join(F.broadcast(totals), "tree")
    everything = F.col("all_zeros").cast("double"), F.col("all_ones").cast("double")
    score = purity(F.col("l_zeros"), F.col("l_ones"), *everything) + purity(
        F.col("zeros") - F.col("l_zeros"), F.col("ones") - F.col("l_ones"), *everything)
    scored = splits.where((F.col("l_rows") >= min_leaf) & (F.col("rows") - F.col("l_rows") >= min_leaf)).withColumn("score", score)
    best = F.struct("score", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "l_zeros", "l_ones", "l_rows")
    return scored.where(F.col("score") > purity(F.col("zeros"), F.col("ones"), *everything)).groupBy("tree", "node").agg(
        F.max(best).alias("best")).select("tree", "node", (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("bin"),
                                          "best.l_zeros", "best.l_ones", "best.l_rows")


def tree_totals(sampled: DataFrame) -> DataFrame:
    """Per tree: copies of each class and rows in its bootstrap."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, _, copies in _chunks(batches):
            ones = [tree[label == 1].sum(dtype=np.int64) for tree in copies]
            total = copies.sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(1, len(copies) + 1, dtype=np.int32)), *(pa.array(np.asarray(v, np.int64)) for v in (
                    total - ones, ones, [np.count_nonzero(tree) for tree in copies]))], names=["tree", "all_zeros", "all_ones", "all_rows"])

    return sampled.mapInArrow(count, "tree int, all_zeros bigint, all_ones bigint, all_rows bigint").groupBy("tree").agg(
        *(F.sum(c).alias(c) for c in ("all_zeros", "all_ones", "all_rows")))


def _cuts(rows: DataFrame, key: str, features: str, seed: int) -> list[list[float]] | None:
    """Split points from the rows with the smallest digests; ``None`` without rows."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    sample = [r[0] for r in rows.orderBy(digest, F.col(key)).limit(CUT_SAMPLE).select(features).collect()]
    return cut_points(np.array(sample, float).reshape(len(sample), -1)) if sample else None


def bag(table: DataFrame, *, key: str = "account_id", label: str = LABEL, features: str = "x", trees: int = TREES, seed: int = SEED,
        cuts: list[list[float]] | None = None) -> DataFrame:
    """Binned rows with their copies in every tree: ``label, bins, copies``, the last two as bytes."""
    rows = table.where(F.col(label).isNotNull())
    cuts = cuts or _cuts(rows, key, features, seed) or []
    return bootstraps(rows.select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("label"),
                                  _binned(F.col(features), cuts).alias("bins")), trees, seed)


def fit_forest(table: DataFrame, *, key: str = "account_id", label: str = LABEL, features: str = "x", trees: int = TREES,
               depth: int = MAX_DEPTH, min_leaf: int = MIN_LEAF, seed: int = SEED) -> DataFrame:
    """The nodes of a forest fitted on ``key``, ``label`` (0 or 1) and ``features`` (an array without gaps)."""
    spark = table.sparkSession
    cuts = _cuts(table.where(F.col(label).isNotNull()), key, features, seed)
    if cuts is None:
        return spark.createDataFrame([(t + 1, 1, None, None, None, None, 0, 0, 0, 0.0) for t in range(trees)], NODES)
    sampled = stage(bag(table, key=key, label=label, features=features, trees=trees, seed=seed, cuts=cuts))
    totals = stage(tree_totals(sampled))
    root = {r["tree"]: r for r in totals.collect()}

    def node(tree: int, number: int, zeros: int, ones: int, count: int) -> dict:
        a = zeros / root[tree]["all_zeros"] if root[tree]["all_zeros"] else 0.0
        b = ones / root[tree]["all_ones"] if root[tree]["all_ones"] else 0.0
        share = float(np.floor(b / (a + b) * GRID) / GRID) if a + b else 0.0
        return dict(tree=tree, node=number, feature=None, split=None, left=None, right=None, zeros=zeros, ones=ones, rows=count,
                    probability=share)

    grown = {(t, 1): node(t, 1, r["all_zeros"], r["all_ones"], r["all_rows"]) for t, r in root.items()}
    growing = _Growing(trees, depth)
    fresh = list(grown.values())
    for level in range(depth):
        drawn: dict[int, dict[int, list[int]]] = {}
        for n in fresh:
            if n["rows"] >= 2 * min_leaf and n["zeros"] and n["ones"]:
                drawn.setdefault(n["tree"] - 1, {})[n["node"]] = drawn_features(n["tree"], n["node"], len(cuts), seed)
        if not drawn:
            break
        shared = spark.sparkContext.broadcast(growing), spark.sparkContext.broadcast(drawn)
        fresh = []
        for best in best_splits(_histograms(sampled, *shared, level), totals, min_leaf).collect():
            parent = grown[best["tree"], best["node"]]
            at, low = best["node"], 2 * best["node"]
            parent.update(feature=best["feature"], split=cuts[best["feature"]][best["bin"]], left=low, right=low + 1)
            growing.feature[best["tree"] - 1, at], growing.bin[best["tree"] - 1, at] = best["feature"], best["bin"]
            taken = [best[f"l_{c}"] for c in ("zeros", "ones", "rows")]
            left = [parent[c] - t for c, t in zip(("zeros", "ones", "rows"), taken)]
            fresh += [node(best["tree"], low, *taken), node(best["tree"], low + 1, *left)]
        grown |= {(n["tree"], n["node"]): n for n in fresh}
    names = [field.split()[0] for field in NODES.split(", ")]
    return spark.createDataFrame([tuple(n[c] for c in names) for _, n in sorted(grown.items())], NODES)


def walk(table: DataFrame, nodes: DataFrame, features: str = "x", name: str = "churn_probability") -> DataFrame:
    """``table`` with the mean, over trees, of the probability of the leaf each row falls into.

    The table of nodes, bounded by the size of the forest, is sent to every task; rows stay where they are.
    """
    forest = nodes.toArrow()
    trees, numbers = (forest.column(c).to_numpy() for c in ("tree", "node"))
    places = {key: i for i, key in enumerate(zip(trees.tolist(), numbers.tolist()))}
    # A node without children leads to itself, whichever way.
    child = np.array([[places.get((t, n), i) if n is not None else i for i, (t, n) in enumerate(zip(
        trees.tolist(), forest.column(side).to_pylist()))] for side in ("left", "right")], np.int64).reshape(2, -1).T.ravel()
    split = np.array(forest.column("split").to_numpy(zero_copy_only=False), float)
    feature = np.array([0 if f is None else f for f in forest.column("feature").to_pylist()], np.int64)
    roots = {t: places[t, 1] for t in sorted(set(trees.tolist())) if (t, 1) in places}
    deepest = dict.fromkeys(trees.tolist(), 0)
    for t, n in places:
        deepest[t] = max(deepest[t], n.bit_length() - 1)
    shared = table.sparkSession.sparkContext.broadcast((
        [(root, deepest[t]) for t, root in roots.items()], child, feature, split, forest.column("probability").to_numpy()))
    column = table.columns.index(features)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, child, of, at, probability = shared.value
        for batch in batches:
            total = np.zeros(batch.num_rows)
            values = _matrix(batch.column(column)) if batch.num_rows else np.empty((0, 1))
            flat, start = np.ascontiguousarray(values).ravel(), np.arange(batch.num_rows) * values.shape[1]
            for root, depth in roots:
                place = np.full(batch.num_rows, root)
                for _ in range(depth):
                    place = child[2 * place + np.logical_not(flat[start + of[place]] <= at[place])]
                total += probability[place]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total / max(1, len(roots)))], names=[*batch.schema.names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields), f"`{name}` double"])
    return table.mapInArrow(score, schema)


@dataclass(frozen=True)
class ForestModel:
    """Fitted preprocessing and the table of nodes."""

    prepare: PipelineModel
    nodes: DataFrame

    def save(self, path: str) -> None:
        self.prepare.write().overwrite().save(f"{path}/preprocessing")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        return ForestModel(PipelineModel.load(f"{path}/preprocessing"), spark.read.parquet(f"{path}/nodes"))


def vectors(prepare: PipelineModel, features: DataFrame) -> DataFrame:
    return prepare.transform(features).select(*features.columns, vector_to_array(F.col("features")).alias("x"))


def fit(features: DataFrame, *, seed: int = SEED, trees: int = TREES) -> ForestModel:
    """Preprocessing and forest of the account features."""
    prepare = Pipeline(stages=preprocessing(CATEGORICAL, NUMERIC)).fit(features).copy()
    return ForestModel(prepare, stage(fit_forest(vectors(prepare, features), seed=seed, trees=trees)))


def score(model: ForestModel, features: DataFrame) -> DataFrame:
    """The feature table with ``churn_probability``."""
    return walk(vectors(model.prepare, features), model.nodes).drop("x")


@dataclass(frozen=True)
class TrainedForest:
    model: ForestModel
    holdout: DataFrame
    metrics: DataFrame


def train(features: DataFrame, seed: int = SEED, trees: int = TREES) -> TrainedForest:
    """Fit on three quarters of the accounts and measure on the rest; the threshold is chosen on that rest, too."""
    marked = stage(with_holdout(features, "account_id", LABEL, "_holdout", seed=seed))
    model = fit(marked.where(~F.col("_holdout")).drop("_holdout"), seed=seed, trees=trees)
    holdout = stage(score(model, marked.where("_holdout").drop("_holdout")))
    overall = features.agg(F.avg(LABEL)).scalar()
    metrics = ranking_metrics(pr_curve(holdout, LABEL, "churn_probability")).withColumn("positive_rate", overall)
    return TrainedForest(model, holdout, metrics)
