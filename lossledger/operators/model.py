"""Churn model on Spark ML: split, class weights, preprocessing, forest, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossledger.operators.evaluate import pr_curve, ranking_metrics
from lossledger.operators.features import CATEGORICAL, LABEL, NUMERIC
from lossledger.operators.profile import medians
from lossledger.session import stage
from lossledger.settings import HOLDOUT_FRACTION, SEED

# Forest size and limits.
TREES = 300
MAX_DEPTH = 10
MIN_LEAF = 4

SPLIT_RANGES = 4096


def with_holdout(df: DataFrame, key: str, stratum: str, name: str = "is_holdout", fraction: float = HOLDOUT_FRACTION,
                 seed: int = SEED) -> DataFrame:
    """Mark the exact rounded ``fraction`` of each class: the rows with the smallest hashes.

    The choice depends on the rows alone. Hashes are ranked within ranges of their values; only
    the range totals, at most ``SPLIT_RANGES`` rows per class, are added up in one place and
    broadcast, so no class is sorted by one task.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(stratum).cast("string"), F.col(key).cast("string")))
    numbered = df.withColumn("_hash", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")).withColumn(
        "_range", F.floor(F.col("_hash") / (2**32 // SPLIT_RANGES)))
    whole = Window.partitionBy(stratum)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = numbered.groupBy(stratum, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(stratum).alias("_stratum"), F.col("_range").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.round(F.sum("_n").over(whole) * fraction).alias("_wanted"))
    within = Window.partitionBy(stratum, "_range").orderBy("_hash", key)
    same = F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_range") == F.col("_of"))
    placed = numbered.withColumn("_rank", F.row_number().over(within)).join(F.broadcast(ranges), same)
    return placed.select(*df.columns, (F.col("_before") + F.col("_rank") <= F.col("_wanted")).alias(name))


def with_class_weight(df: DataFrame, label: str = LABEL, name: str = "class_weight") -> DataFrame:
    """Weight n / (2 * n_class), so both classes carry half of the total weight."""
    counts = df.agg(F.struct(F.count(label).alias("n"), F.sum(F.col(label).cast("bigint")).alias("ones"))).scalar()
    ones, n = counts["ones"], counts["n"]
    of_class = F.when(F.col(label) == 1, ones).otherwise(n - ones)
    return df.withColumn(name, n / (2.0 * of_class))


class MedianImputer(Estimator):
    """Fits to a transformer that fills nulls and NaN with the exact median of the training rows.

    ``columns`` maps inputs to outputs. A column without any value is filled with 0.
    """

    def __init__(self, columns: Mapping[str, str]):
        super().__init__()
        self.columns = dict(columns)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        found = medians(dataset, list(self.columns))
        filled = [f"coalesce(nanvl({c}, CAST(NULL AS DOUBLE)), {found[c] or 0.0!r}D) AS {out}" for c, out in self.columns.items()]
        return SQLTransformer(statement=f"SELECT {', '.join(['*', *filled])} FROM __THIS__")


def build_pipeline(
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    label: str = LABEL,
    seed: int = SEED,
    trees: int = TREES,
) -> Pipeline:
    """Preprocessing and forest as one Spark ML pipeline."""
    forest = RandomForestClassifier(
        labelCol=label,
        featuresCol="features",
        weightCol="class_weight",
        numTrees=trees,
        maxDepth=MAX_DEPTH,
        minInstancesPerNode=MIN_LEAF,
        seed=seed,
    )
    return Pipeline(stages=[*preprocessing(categorical, numeric), forest])


def preprocessing(categorical: Sequence[str] = CATEGORICAL, numeric: Sequence[str] = NUMERIC) -> list:
    """Most-frequent and median imputation, one-hot encoding, assembly into a vector.

    The indexer numbers values by falling frequency, so a missing value becomes index 0, the
    most frequent one. A value unseen in training gets the extra last index, which the encoder
    drops to an all-zero vector.
    """
    indexed = [f"{c}_index" for c in categorical]
    filled = [f"{c}_filled" for c in categorical]
    encoded = [f"{c}_onehot" for c in categorical]
    numbers = [f"{c}_number" for c in numeric]
    imputed = [f"{c}_imputed" for c in numeric]
    filling = [f"CASE WHEN {c} IS NULL THEN 0.0D ELSE {i} END AS {f}" for c, i, f in zip(categorical, indexed, filled)]
    casting = [f"CAST({c} AS DOUBLE) AS {n}" for c, n in zip(numeric, numbers)]
    typed = SQLTransformer(statement=f"SELECT {', '.join(['*', *filling, *casting])} FROM __THIS__")
    return [
        StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
        typed,
        OneHotEncoder(inputCols=filled, outputCols=encoded, handleInvalid="keep", dropLast=True),
        MedianImputer(dict(zip(numbers, imputed))),
        VectorAssembler(inputCols=[*encoded, *imputed], outputCol="features", handleInvalid="keep"),
    ]


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """The feature table with ``churn_probability``."""
    positive = F.coalesce(F.get(vector_to_array(F.col("probability")), F.lit(1)), F.lit(0.0))
    return model.transform(features).select(*features.columns, positive.alias("churn_probability"))


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    holdout: DataFrame
    metrics: DataFrame


def train(features: DataFrame, seed: int = SEED, trees: int = TREES) -> Trained:
    """Fit on three quarters of the accounts and measure on the rest.

    ``features`` should be a stored table: fitting reads it several times. The threshold in the
    metrics is chosen on the same hold-out it is measured on.
    """
    marked = stage(with_holdout(features, "account_id", LABEL, "_holdout", seed=seed))
    fit_on = with_class_weight(marked.where(~F.col("_holdout")).drop("_holdout"))
    # The copy carries no training summary, which holds on to the session and its data.
    model = build_pipeline(seed=seed, trees=trees).fit(fit_on).copy()
    holdout = score(model, marked.where("_holdout").drop("_holdout"))
    overall = features.agg(F.avg(LABEL)).scalar()
    metrics = ranking_metrics(pr_curve(holdout, LABEL, "churn_probability")).withColumn("positive_rate", overall)
    return Trained(model, holdout, metrics)
