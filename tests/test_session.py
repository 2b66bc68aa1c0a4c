import pytest

from lossledger.session import RECOMMENDED, apply_settings, stage


def test_settings(spark):
    apply_settings(spark)
    assert all(spark.conf.get(k) == v for k, v in RECOMMENDED.items())


def test_stage_cuts_the_lineage(spark):
    df = stage(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ExistingRDD" in plan
    assert df.count() == 7 and spark.sparkContext.getCheckpointDir() is not None


class Elsewhere:
    """A session on a cluster, as far as ``stage`` looks."""

    def __init__(self, folder):
        self.folder, self.sparkContext, self.sparkSession, self.conf = folder, self, self, self
        self.master, self.used = "spark://host:7077", None

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, folder):
        self.used = folder

    def get(self, key, default):
        return self.folder or default

    def checkpoint(self, eager):
        return "stored"


def test_stage_takes_the_folder_of_the_session():
    cluster = Elsewhere("hdfs:///shared")
    assert stage(cluster) == "stored" and cluster.used == "hdfs:///shared"


def test_stage_never_uses_a_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage(Elsewhere(None))
