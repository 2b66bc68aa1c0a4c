"""Where the query modules register their Spark query and, if there is one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from catalog.sql_views import with_views
from lossledger.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, path: str) -> DataFrame:
            return days_as_text(build(apply_settings(spark), path))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql)
        return build

    return add


def days_as_text(df: DataFrame) -> DataFrame:
    """Days as ISO text, so that both engines report them alike."""
    days = [f.name for f in df.schema.fields if isinstance(f.dataType, DateType)]
    return df.withColumns({d: F.col(d).cast("string") for d in days}) if days else df
