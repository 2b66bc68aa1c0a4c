import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lossledger.operators import model
from lossledger.operators.features import CATEGORICAL, LABEL, NUMERIC
from tests.conftest import rows


@pytest.fixture(scope="module")
def separable(spark):
    """Accounts that leave when they create few projects, with missing values here and there."""
    rng = random.Random(3)
    data = []
    for i in range(800):
        projects = rng.random() * 10
        left = int(projects < 2.5)
        numbers = [projects if c == "avg_projects_created" else rng.random() for c in NUMERIC]
        kinds = [rng.choice(["x", "y", None]) for _ in CATEGORICAL]
        data.append((f"a{i}", *kinds, *numbers, left))
    schema = ", ".join(
        ["account_id string", *(f"{c} string" for c in CATEGORICAL), *(f"{c} double" for c in NUMERIC), f"{LABEL} int"]
    )
    return spark.createDataFrame(data, schema).cache()


@pytest.fixture(scope="module")
def trained(separable):
    return model.train(separable, trees=20)


def test_separable_fixture_is_learned(trained):
    metrics = trained.metrics.first().asDict()
    assert metrics["roc_auc"] > 0.95 and metrics["f1"] > 0.8
    assert 0 < metrics["optimal_threshold"] < 1


def test_positive_rate_covers_all_accounts(separable, trained):
    assert trained.metrics.first()["positive_rate"] == separable.agg(F.avg(LABEL)).first()[0]


def test_every_account_is_scored(separable, trained):
    scored = model.score(trained.model, separable)
    assert scored.columns == [*separable.columns, "churn_probability"]
    assert scored.where("churn_probability between 0 and 1").count() == separable.count()


def test_reloaded_model_gives_the_same_scores(separable, trained, tmp_path):
    trained.model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    pick = ["account_id", "churn_probability"]
    assert sorted(rows(model.score(again, separable).select(pick))) == sorted(
        rows(model.score(trained.model, separable).select(pick))
    )


def test_holdout_is_the_exact_share_of_each_class_and_stable(separable):
    held = model.with_holdout(separable, "account_id", LABEL, "held")
    shares = rows(held.groupBy(LABEL).agg(F.sum(F.col("held").cast("int")), F.count(F.lit(1))))
    assert all(kept == round(0.25 * n) for _, kept, n in shares)
    again = model.with_holdout(separable.repartition(5), "account_id", LABEL, "held")
    pick = ["account_id", "held"]
    assert sorted(rows(held.select(pick))) == sorted(rows(again.select(pick)))
    assert model.with_holdout(separable, "account_id", LABEL, "held", fraction=0.0).where("held").count() == 0


def test_class_weights_balance(separable):
    weighted = model.with_class_weight(separable)
    totals = [r[0] for r in rows(weighted.groupBy(LABEL).agg(F.sum("class_weight").alias("w")).select("w"))]
    assert totals == pytest.approx([400.0, 400.0])


def test_categories_missing_and_unseen(spark):
    train = spark.createDataFrame([("b",), ("b",), ("a",), (None,)], "kind string")
    stages = model.preprocessing(["kind"], [])[:3]
    fitted = Pipeline(stages=stages).fit(train)
    new = spark.createDataFrame([("b",), ("a",), (None,), ("zzz",)], "kind string")
    got = rows(fitted.transform(new).select("kind", vector_to_array(F.col("kind_onehot"))))
    assert got == [("b", [1.0, 0.0]), ("a", [0.0, 1.0]), (None, [1.0, 0.0]), ("zzz", [0.0, 0.0])]


def test_median_fills_missing_numbers(spark):
    train = spark.createDataFrame([(1,), (2,), (9,), (None,)], "n int")
    stages = [s for s in model.preprocessing([], ["n"]) if type(s).__name__ in ("SQLTransformer", "MedianImputer")]
    got = rows(Pipeline(stages=stages).fit(train).transform(train).select("n_imputed"))
    assert got == [(1.0,), (2.0,), (9.0,), (2.0,)]


def test_median_is_the_mean_of_the_middle_two_and_skips_what_is_missing(spark):
    nan = float("nan")
    train = spark.createDataFrame([(4.0, nan, None), (1.0, 7.0, None), (None, -3.0, None), (9.0, None, None), (2.0, 7.0, None)],
                                  "a double, b double, c double")
    fitted = model.MedianImputer({c: f"{c}_full" for c in "abc"}).fit(train.repartition(3))
    got = rows(fitted.transform(train).select("a_full", "b_full", "c_full"))
    assert got == [(4.0, 7.0, 0.0), (1.0, 7.0, 0.0), (3.0, -3.0, 0.0), (9.0, 7.0, 0.0), (2.0, 7.0, 0.0)]
    empty = model.MedianImputer({"a": "a_full"}).fit(train.limit(0))
    assert rows(empty.transform(train.where("a = 4")).select("a_full")) == [(4.0,)]


def test_forest_settings():
    forest = model.build_pipeline().getStages()[-1]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getSeed()) == (300, 10, 4, 42)
