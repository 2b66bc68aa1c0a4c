"""Reading the business tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lossledger.session import stage
from lossledger.sources.schemas import SCHEMAS


@dataclass(frozen=True)
class Tables:
    accounts: DataFrame
    deals: DataFrame
    usage: DataFrame
    support: DataFrame
    notes: DataFrame
    cancellations: DataFrame


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "csv", multiline: bool = False) -> DataFrame:
    """One table with its declared schema; a value that does not fit its type is an error.

    ``multiline`` accepts line breaks inside quoted text, at the price of one task per file.
    """
    reader = spark.read.schema(SCHEMAS[name])
    if fmt == "csv":
        return reader.csv(
            f"{path}/{name}.csv",
            header=True,
            enforceSchema=False,
            mode="FAILFAST",
            quote='"',
            escape='"',
            multiLine=multiline,
        )
    return reader.format(fmt).load(f"{path}/{name}")


BAD_RECORD = "_bad_record"


def read_checked(spark: SparkSession, path: str, name: str, *, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """The good rows of a CSV table, and its lines that do not fit the schema (``table_name, line``).

    A line is bad if a value does not fit its type or the number of values is wrong. Both parts come from
    one pass over the file, which is stored: Spark parses a line again for every plan that asks what was wrong.
    """
    schema = StructType.fromDDL(SCHEMAS[name]).add(BAD_RECORD, "string")
    parsed = stage(spark.read.schema(schema).csv(
        f"{path}/{name}.csv", header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_RECORD,
        quote='"', escape='"', multiLine=multiline))
    bad = F.col(BAD_RECORD).isNotNull()
    return parsed.where(~bad).drop(BAD_RECORD), parsed.where(bad).select(
        F.lit(name).alias("table_name"), F.col(BAD_RECORD).alias("line"))


def load_checked(spark: SparkSession, path: str, multiline: bool = False) -> tuple[Tables, DataFrame]:
    """The six CSV tables without their bad lines, and those lines as one table."""
    read = {name: read_checked(spark, path, name, multiline=multiline) for name in SCHEMAS}
    good = {name: rows for name, (rows, _) in read.items()}
    quarantine = reduce(DataFrame.unionByName, (bad for _, bad in read.values()))
    return Tables(good["accounts"], good["deals"], good["product_usage"], good["support_tickets"], good["sales_notes"],
                  good["cancellations"]), quarantine


def load_tables(spark: SparkSession, path: str, fmt: str = "csv", multiline: bool = False) -> Tables:
    """The six business tables under ``path``: ``<name>.csv``, or ``<name>`` in another format."""
    def read(name: str) -> DataFrame:
        return read_table(spark, path, name, fmt, multiline)

    return Tables(
        accounts=read("accounts"),
        deals=read("deals"),
        usage=read("product_usage"),
        support=read("support_tickets"),
        notes=read("sales_notes"),
        cancellations=read("cancellations"),
    )
