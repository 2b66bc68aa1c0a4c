"""Writing result tables and metrics, reading them back, and checking that they are there."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lossledger.functions.numbers import round_half_even
from lossledger.operators.evaluate import METRICS

PROCESSED = "processed"
ARTIFACTS = "artifacts"
MODEL = f"{ARTIFACTS}/churn_model"
TYPES = "_types"  # beside a CSV or partitioned table: its schema, which the files or folder names lack
PARTITIONS = {"revenue_loss_trend": "period"}
METRICS_PATH = f"{ARTIFACTS}/model_metrics"

# Outputs the reporting views read.
REQUIRED = (
    "account_risk_scores",
    "revenue_loss_summary",
    "revenue_loss_trend",
    "recommendations",
    "segment_loss",
    "sales_notes_classified",
    "support_tickets_classified",
    "cancellations_classified",
)


# One choice for writing and reading: quotes inside text are doubled, blanks at its ends stay, an
# empty text stays one, a missing value is a token of its own, and line breaks may stand inside quotes.
NULL = "\\N"
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": '""',
    "nullValue": NULL,
}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", null: str = NULL, *, partition: str | None = None) -> int:
    """Write a table and return its number of rows, counted while it is written.

    ``null`` is how CSV shows a missing value; only with the default can empty texts be told apart.
    ``partition`` gives every value of that column a folder, so a reader of one value opens no other.
    """
    return _write(df, path, fmt, null, partition, "static")


def refresh_partitions(df: DataFrame, path: str, partition: str, fmt: str = "parquet", null: str = NULL) -> int:
    """Replace the folders of those values of ``partition`` that ``df`` has; all others stay untouched."""
    return _write(df, path, fmt, null, partition, "dynamic")


def _write(df: DataFrame, path: str, fmt: str, null: str, partition: str | None, overwrite: str) -> int:
    counted = Observation()
    observed = df.observe(counted, F.count(F.lit(1)).alias("rows"))
    writer = observed.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", overwrite)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS | {"nullValue": null})
    if partition is not None:
        writer = writer.partitionBy(partition)
    writer.save(path)
    if fmt == "csv" or partition is not None:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{path}{TYPES}")
    return counted.get["rows"]


def table_path(root: str, name: str) -> str:
    return f"{root}/{PROCESSED}/{name}"


def write_metrics(metrics: DataFrame, root: str) -> None:
    """One JSON line, four decimals."""
    rounded = metrics.select(*(round_half_even(F.col(c), 4).alias(c) for c in metrics.columns))
    rounded.write.mode("overwrite").json(f"{root}/{METRICS_PATH}")


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    schema = ", ".join(f"{m} double" for m in METRICS)
    return spark.read.schema(schema).json(f"{root}/{METRICS_PATH}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def outputs_ready(spark: SparkSession, root: str, names: Iterable[str] = REQUIRED) -> bool:
    """Whether every output was written to the end."""
    paths = [*(table_path(root, n) for n in names), f"{root}/{METRICS_PATH}"]
    return all(exists(spark, f"{p}/_SUCCESS") for p in paths)


def read_output(spark: SparkSession, path: str, fmt: str, schema: StructType | None = None, *, partitioned: bool = False) -> DataFrame:
    """A written table with the types it was written with.

    CSV holds no types and folder names hold texts, so the types lie beside the table as an empty Parquet file.
    """
    if fmt != "csv" and not partitioned:
        return spark.read.format(fmt).load(path)
    schema = schema or spark.read.parquet(f"{path}{TYPES}").schema
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS | {"emptyValue": "", "mode": "FAILFAST", "multiLine": True})
    return reader.load(path).select(*(F.col(f"`{c}`") for c in schema.names))


def load_outputs(
    spark: SparkSession, root: str, names: Iterable[str] = REQUIRED, fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """The written outputs by name; a missing one raises ``AnalysisException``."""
    outputs = {n: read_output(spark, table_path(root, n), fmt, partitioned=n in PARTITIONS) for n in names}
    outputs["model_metrics"] = read_metrics(spark, root)
    return outputs
