"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into source blocks by content. For each block the number of rows that go to every
target is drawn from the multivariate hypergeometric distribution, given how much room the targets
have left; so all column sums are exact and the whole is distributed as a uniform permutation cut
into shards. Then each block is permuted, its first rows go to the first target, the next to the
second, and so on; each target is permuted again. A target is a bounded part of a shard, so no
task ever sorts a whole shard.

The matrix has at most ``MAX_BLOCKS`` squared numbers: it is drawn on the driver from the block
counts alone and broadcast.

Defined results: a null text has no bytes (size 1) and the check sum of an empty text; null ids
are dealt like any other; repeated rows are dealt each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import staged

MAX_BLOCKS = 512
BLOCK_ROWS = 1_000_000


def communication_matrix(counts: list[int], targets: list[int], seed: int) -> np.ndarray:
    """Rows: blocks, columns: targets; sums are ``counts`` and ``targets``."""
    rng, room = np.random.default_rng(seed), np.array(targets, np.int64)
    rows = []
    for count in counts:
        rows.append(rng.multivariate_hypergeometric(room, count, method="marginals"))
        room = room - rows[-1]
    return np.array(rows, np.int64).reshape(len(counts), len(targets))


def _even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: shard sizes differ by one at most, slots have no gaps.

    ``df`` should be narrow, for it is stored and shuffled twice; wide rows follow by a join on
    their id.
    """
    spark, df = df.sparkSession, staged(df)
    content = [F.col(f"`{c}`") for c in df.columns]
    total = df.count()
    blocks = min(MAX_BLOCKS, max(8, -(-total // block_rows)))
    block = F.pmod(F.xxhash64(F.lit(seed), *content), F.lit(blocks)).cast("int")
    found = dict(df.groupBy(block.alias("b")).count().collect())
    counts = [found.get(b, 0) for b in range(blocks)]
    parts = max(1, min(MAX_BLOCKS // shards, -(-total // (shards * block_rows))))
    sizes = [_even(size, parts) for size in _even(total, shards)]
    matrix = communication_matrix(counts, [x for row in sizes for x in row], seed)
    first = [np.concatenate([[0], np.cumsum(row)[:-1]]).tolist() for row in sizes]

    ends = np.cumsum(matrix, axis=1)
    lookup = spark.createDataFrame(
        [(b, ends[b].tolist()) for b in range(blocks)], "_block int, _ends array<bigint>")
    begins = F.array(*[F.lit(x) for row in first for x in row])
    order = [F.xxhash64(F.lit(seed + 1), *content), F.xxhash64(F.lit(seed + 2), *content)]
    local = Window.partitionBy("_block").orderBy(*order)
    again = Window.partitionBy("_target").orderBy(*[F.xxhash64(F.lit(seed + i), *content) for i in (3, 4)])
    return (
        df.withColumn("_block", block)
        .withColumn("_rank", F.row_number().over(local))
        .join(F.broadcast(lookup), "_block")
        .withColumn("_target", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
        .withColumn("_place", F.row_number().over(again))
        .select(*content, (F.col("_target") / parts).cast("int").alias("shard"),
                (F.element_at(begins, F.col("_target") + 1) + F.col("_place") - 1).alias("slot"))
    )


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16,
                    seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document row: id, size, check sum of the text, law, shard and slot in the shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(slim, shards, seed, block_rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
