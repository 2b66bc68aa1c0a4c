"""Session settings the jobs rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings only: executor sizing belongs to the cluster's own configuration.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``, which all executors share.

    Only a local session may fall back to a folder of its own; a cluster without the setting is an
    error, because a folder on one machine would be lost with that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix=f"lossledger-{purpose}-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in reliable storage that survives lost executors.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session may fall back
    to a folder of its own; a cluster without the setting is an error, because a folder on
    one machine would be lost with that machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="lossledger-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def dealt_out(df: DataFrame) -> DataFrame:
    """``df`` spread evenly over as many tasks as the session has shuffle partitions.

    A row group is read by one task however many rows it has; this comes before work that takes long per
    row. Rows go by their place, so repeated or missing keys do not meet in one task.
    """
    place = "_place" + "_" * max((len(name) for name in df.columns), default=0)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn(place, F.monotonically_increasing_id()).repartition(tasks, place).drop(place)
