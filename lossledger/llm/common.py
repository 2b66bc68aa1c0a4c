"""What the operators share: table access, staging, and bounded sketches merged over partitions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.hashing import mix

BATCH_ROWS = 1000
BLOCK = 16  # the cells of a sketch travel in blocks of 2 ** BLOCK


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may lack that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lossledger-stage-")
    return f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"


_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def staged(df: DataFrame, *, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: a later loss of executors repeats
    nothing that came before, and readers take only the columns they need.

    Inside ``removed_after`` the folder goes at the end, unless ``keep`` is set. Elsewhere it stays.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    schema = df.schema
    if not keep and (folders := _FOLDERS.get()) is not None:
        folders.append(folder)
    df.write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Remove the folders that ``staged`` makes inside; only DataFrames stored with ``keep`` can be read later.

    Nothing else below ``spark.checkpoint.dir`` is touched. Inside another such block each removes its own.
    """
    token = _FOLDERS.set([])
    try:
        yield
    finally:
        folders = _FOLDERS.get()
        _FOLDERS.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_type(name: str) -> pa.DataType:
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
    }[name]


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows.

    Rows may hold whole texts, and a batch is held by the executor and by its Python worker at once; so the
    session's limit of rows a batch is lowered, for later jobs as well.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def map_rows(df: DataFrame, schema: dict[str, str], rows: Callable[[Iterator[dict]], Iterable[tuple]],
             size: int = 2000) -> DataFrame:
    """``mapInArrow`` over rows: ``rows`` turns an iterator of dicts into output tuples.

    Output leaves in batches of ``size`` rows, so a task holds one input and one output batch.
    """
    fields = [pa.field(n, arrow_type(t)) for n, t in schema.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def incoming() -> Iterator[dict]:
            for batch in batches:
                names = batch.schema.names
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    yield from (dict(zip(names, r)) for r in zip(*(c.to_pylist() for c in part.columns)))

        kept: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*kept)) if kept else [()] * len(fields)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))

        for row in rows(incoming()):
            kept.append(row)
            if len(kept) == size:
                yield flush()
                kept.clear()
        if kept:
            yield flush()

    return map_batches(df, run, ", ".join(f"`{n}` {t}" for n, t in schema.items()))


@dataclass(frozen=True)
class Sketch:
    """``depth`` rows of ``2 ** bits`` counters of ``dtype``; a counter stops at ``top``.

    Its size does not depend on the data: ``depth * 2 ** bits`` counters, which is what is
    merged, collected and broadcast. Counts are never too low below ``top``.
    """

    depth: int
    bits: int
    dtype: str
    top: int

    @property
    def size(self) -> int:
        return self.depth << self.bits

    def empty(self) -> np.ndarray:
        return np.zeros(self.size, self.dtype)

    def places(self, keys: np.ndarray, row: int) -> np.ndarray:
        spread = keys * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[row])
        return ((spread ^ (spread >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                >> np.uint64(64 - self.bits)).astype(np.int64) + (row << self.bits)

    def add(self, cells: np.ndarray, keys: np.ndarray) -> None:
        for row in range(self.depth):
            place, count = np.unique(self.places(keys, row), return_counts=True)
            self._raise(cells, place, count)

    def _raise(self, cells: np.ndarray, place, count) -> None:
        cells[place] = np.minimum(cells[place].astype(np.int64) + count, self.top).astype(self.dtype)

    def estimate(self, cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
        best = cells[self.places(keys, 0)]
        for row in range(1, self.depth):
            best = np.minimum(best, cells[self.places(keys, row)])
        return best

    def dump(self, cells: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """Block number, places in the block and their counts; blocks without counts stay away."""
        for block in range(max(1, self.size >> BLOCK)):
            part = cells[block << BLOCK : (block + 1) << BLOCK]
            place = np.flatnonzero(part)
            if len(place):
                yield block, place.astype("<u2").tobytes(), part[place].tobytes()

    def load(self, cells: np.ndarray, block: int, place: bytes, count: bytes) -> None:
        self._raise(cells, np.frombuffer(place, "<u2").astype(np.int64) + (block << BLOCK),
                    np.frombuffer(count, self.dtype).astype(np.int64))

    def holder(self, members: DataFrame, name: str) -> Callable[[np.ndarray], np.ndarray]:
        """A test, for use in tasks, whether whole numbers are in column ``name`` of ``members``; a few others pass as well.

        A bit for each counter goes to the tasks.
        """
        held = members.sparkSession.sparkContext.broadcast(np.packbits(
            merged_sketch(members, self, lambda row: mix(np.array([row[name]], "i8").view("u8"))) > 0, bitorder="little"))

        def test(numbers: np.ndarray) -> np.ndarray:
            keys = mix(numbers.view("u8"))
            found = np.ones(len(keys), bool)
            for row in range(self.depth):
                place = self.places(keys, row)
                found &= (held.value[place >> 3] >> (place & 7) & 1).astype(bool)
            return found

        return test

    def may_hold(self, members: DataFrame, name: str) -> Column:
        """The test of ``holder`` for the numbers in column ``name``; no more of a row than its number leaves the executor."""
        holds = self.holder(members, name)

        def test(numbers: pa.Array) -> pa.Array:
            return pa.array(holds(numbers.fill_null(0).to_numpy(zero_copy_only=False)))

        test.__annotations__ = {"numbers": pa.Array, "return": pa.Array}
        return F.arrow_udf(test, "boolean")(F.col(name))


SKETCH_ROWS = {"block": "int", "place": "binary", "count": "binary"}


def merged_sketch(df: DataFrame, sketch: Sketch, keys: Callable[[dict], np.ndarray | None]) -> np.ndarray:
    """The sketch of ``keys`` over all rows of ``df``: one per task, merged by block, then collected.

    The driver receives ``sketch.size`` counters at most, whatever the size of ``df``.
    """

    def fill(rows: Iterator[dict]) -> Iterator[tuple]:
        cells, waiting, held = sketch.empty(), [], 0
        for row in rows:
            found = keys(row)
            if found is not None and len(found):
                waiting.append(found)
                held += len(found)
                if held > 1_000_000:
                    sketch.add(cells, np.concatenate(waiting))
                    waiting, held = [], 0
        if waiting:
            sketch.add(cells, np.concatenate(waiting))
        yield from sketch.dump(cells)

    def merge(rows: Iterator[dict]) -> Iterator[tuple]:
        own: dict[int, np.ndarray] = {}
        for row in rows:
            cells = own.setdefault(row["block"], np.zeros(min(1 << BLOCK, sketch.size), sketch.dtype))
            sketch.load(cells, 0, row["place"], row["count"])
        for block, cells in own.items():
            place = np.flatnonzero(cells)
            yield block, place.astype("<u2").tobytes(), cells[place].tobytes()

    partial = map_rows(df, SKETCH_ROWS, fill, size=8)
    whole = map_rows(partial.repartition(F.col("block")), SKETCH_ROWS, merge, size=8)
    cells = sketch.empty()
    for row in whole.collect():
        sketch.load(cells, row["block"], bytes(row["place"]), bytes(row["count"]))
    return cells
