"""Approximate nearest neighbours by cosine: inverted lists scanned dimension by dimension.

Vectors are scaled to length one, so the largest cosine is the smallest distance, and turned by a
random rotation, after which every leading block of columns is a fair sample of the distance. A
query visits its nearest lists. Inside a list the distances grow block by block; after each block a
hypothesis test compares the extrapolated distance with the query's best so far and abandons the
candidates that are too far. Survivors are scored exactly, in double precision, on the original
vectors.

The first (nearest) list of each query gives its starting bound; the other lists begin with it.
Lists are cut into parts of bounded size, and so are the queries that visit them, so a hot list is
many small tasks. Centroids come from a bounded sample; every row is indexed.

Defined results: vectors that are null, empty, zero, of another length than the most, or with null or
non-finite components take no part; ids that are null take no part; equal vectors tie by smaller
id; of several rows with one id the least vector counts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import map_rows, staged

SAMPLE = 20_000  # rows that the centroids are fitted on, the smallest hashes of the id
MAX_LISTS = 4096
LEAST_PROBES, PROBE_SHARE = 8, 0.6  # lists a query visits; clustered vectors need a far smaller share
PART_ROWS = 8_000
PART_QUERIES = 2_000
COLUMNS = 16  # dimensions in a block
DOUBT = 2.1  # how many deviations an extrapolated distance may exceed the bound


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 11, rounds: int = 8) -> np.ndarray:
    """At most ``lists`` centroids; they start as distinct vectors, so a group of equal rows starts one list."""
    rng = np.random.default_rng(seed)
    distinct = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
    lists = min(lists, len(distinct))
    centres = distinct[rng.choice(len(distinct), lists, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        for c in range(lists):
            own = sample[nearest == c]
            if len(own):
                mean = own.sum(axis=0)
                norm = np.linalg.norm(mean)
                if norm > 0:
                    centres[c] = mean / norm
    return centres


def rotation(width: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaling by the largest component first avoids overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def exact_cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    dot = (rows * query).sum(axis=1)
    return dot / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def adaptive_scan(query: np.ndarray, rows: np.ndarray, bound: float, k: int) -> np.ndarray:
    """Positions in ``rows`` (rotated, like ``query``) that no test has abandoned."""
    width, alive = rows.shape[1], np.arange(len(rows))
    partial = np.zeros(len(rows))
    for at in range(0, width, COLUMNS):
        part = rows[alive, at : at + COLUMNS] - query[at : at + COLUMNS]
        partial = partial + (part * part).sum(axis=1)
        seen = min(at + COLUMNS, width)
        if seen == width:
            break
        if len(alive) > k:
            extrapolated = partial * (width / seen)
            # the k candidates that look nearest now bound the k-th distance from above, once complete
            near = alive[np.argpartition(extrapolated, k - 1)[:k]]
            whole = rows[near] - query
            bound = min(bound, float((whole * whole).sum(axis=1).max()))
            keep = extrapolated <= bound * (1 + DOUBT / np.sqrt(seen)) ** 2
            alive, partial = alive[keep], partial[keep]
    return alive[partial <= bound * (1 + 1e-9) + 1e-12] if np.isfinite(bound) else alive


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _search(k: int, turn):
    """Cogroup function: the queries and the vectors of one part of a list."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(vectors):
            ids, plain = vectors["vec_id"].to_numpy(), _matrix(vectors["vector"])
            turned = unit(plain) @ turn.value
            asked = _matrix(queries["asked"])
            turned_asked = unit(asked) @ turn.value
            for i, (query_id, bound) in enumerate(zip(queries["query_id"], queries["bound"])):
                # one more than k, because the query itself may be among the candidates
                alive = adaptive_scan(turned_asked[i], turned, bound, k + 1)
                alive = alive[ids[alive] != query_id]
                if len(alive):
                    score = exact_cosine(asked[i], plain[alive])
                    for j in np.lexsort((ids[alive], -score))[:k]:
                        out.append((query_id, int(ids[alive[j]]), float(score[j])))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5,
            lists: int | None = None, probe_share: float = PROBE_SHARE, sample_rows: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest of each query, nearest first; queries are the rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    widths = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if widths is None:
        return spark.createDataFrame([], result)
    width, total = widths
    rows = rows.where(F.size("vector") == width)
    sample = unit(np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select(
        "vector").collect()]))
    fitted = fit_centroids(sample, lists or max(1, min(MAX_LISTS, round(total ** 0.5))))
    lists = len(fitted)
    probes = min(lists, max(LEAST_PROBES, -(-round(1000 * probe_share) * lists // 1000)))
    centres = spark.sparkContext.broadcast(fitted)
    turn = spark.sparkContext.broadcast(rotation(width))

    def assign(found: Iterator[dict]) -> Iterator[tuple]:
        for row in found:
            near = centres.value @ unit(np.array([row["vector"]]))[0]
            best = np.argsort(-near, kind="stable")[:probes] if row["vec_id"] % every == 0 else [int(near.argmax())]
            yield row["vec_id"], row["vector"], [int(b) for b in best]

    indexed = staged(map_rows(rows.select("vec_id", F.col("vector").cast("array<double>").alias("vector")), {
        "vec_id": "bigint", "vector": "array<double>", "near": "array<int>"}, assign))
    asks = F.col("vec_id") % every == 0
    stored = indexed.select("vec_id", "vector", F.col("near")[0].alias("list"))
    visits = indexed.where(asks).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"), F.posexplode("near").alias("visit", "list"))

    # Parts per list, from counts alone: at most MAX_LISTS rows reach the driver.
    size = dict(stored.groupBy("list").count().collect())
    visited = dict(visits.groupBy("list").count().collect())
    parts = F.array(*[F.lit(-(-size.get(i, 0) // PART_ROWS) or 1) for i in range(lists)])
    teams = F.array(*[F.lit(-(-visited.get(i, 0) // PART_QUERIES) or 1) for i in range(lists)])
    own_part = F.pmod(F.xxhash64("vec_id"), parts[F.col("list")]).cast("int")
    own_team = F.pmod(F.xxhash64("query_id"), teams[F.col("list")]).cast("int")
    key = ["list", "part", "team"]
    spread = stored.withColumn("part", own_part).withColumn(
        "team", F.explode(F.sequence(F.lit(0), teams[F.col("list")] - 1)))
    sent = visits.withColumn("team", own_team).withColumn(
        "part", F.explode(F.sequence(F.lit(0), parts[F.col("list")] - 1)))

    def search(asked: DataFrame) -> DataFrame:
        return asked.groupBy(*key).cogroup(spread.groupBy(*key)).applyInPandas(
            _search(k, turn), "query_id bigint, vec_id bigint, score double")

    def leading(found: DataFrame) -> DataFrame:
        """The k best candidates of each query; the rank limit already prunes before the shuffle."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    home = staged(search(sent.where("visit = 0").withColumn("bound", F.lit(float("inf")))))
    # the k-th candidate of the home list bounds the distance, which is 2 - 2 * cosine
    bounds = leading(home).where(F.col("rank") == k).select("query_id", (2 - 2 * F.col("score")).alias("bound"))
    others = sent.where("visit > 0").join(bounds, "query_id", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("inf"))))
    found = home.unionByName(search(others))
    return leading(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
