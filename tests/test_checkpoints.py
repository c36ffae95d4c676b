import os
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from tallydesk.plans import checkpoints
from tallydesk.plans.checkpoints import checkpoint_stage, shared_folder


def session(master, named=None):
    fake = MagicMock()
    settings = {"spark.master": master, "spark.checkpoint.dir": named}
    fake.conf.get.side_effect = lambda key, default=None: settings[key] if settings[key] is not None else default
    return fake


@pytest.mark.parametrize("master", ["spark://head:7077", "local[4]"])
def test_the_folder_of_the_session_is_used(master):
    assert shared_folder(session(master, "hdfs://shared/checkpoints/")) == "hdfs://shared/checkpoints"


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]"])
def test_several_executors_never_fall_back_to_a_local_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(master))


def test_a_stage_cuts_the_lineage_and_keeps_columns_apart(spark):
    kept = checkpoint_stage(spark.range(10).filter("id > 3").selectExpr("id", "id * 2 AS twice"), "numbers")
    plan = kept.select("twice")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert kept.count() == 6 and "Filter" not in plan and "ReadSchema: struct<twice:bigint>" in plan


def test_tables_on_the_way_go_and_the_result_stays(spark, tmp_path):
    first = checkpoints.parquet_checkpoint(spark.range(3), "before")
    with checkpoints.passing_stages(spark):
        way = checkpoints.parquet_checkpoint(first.withColumn("x", F.lit(1)), "way")
        result = checkpoints.parquet_checkpoint(way.withColumn("y", F.lit(2)), "result")
    gone = way.inputFiles()[0].removeprefix("file://")
    assert result.count() == 3 and first.count() == 3 and not os.path.exists(os.path.dirname(gone))
    with pytest.raises(ZeroDivisionError), checkpoints.passing_stages(spark):
        1 / 0
    assert checkpoints.parquet_checkpoint(spark.range(2), "after").count() == 2


def test_releasing_shuffles_leaves_the_setting_as_it_was(spark, settings):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(RuntimeError), checkpoints.releasing_shuffles(spark):
        assert spark.conf.get(name) == "true"
        raise RuntimeError
    assert spark.conf.get(name) == before
    settings(**{name.replace(".", "__"): "false"})
    with checkpoints.releasing_shuffles(spark):
        pass
    assert spark.conf.get(name) == "false"
