import os
import time

import pytest
from pyspark.sql import functions as F

from trackweave.functions import skew
from trackweave.operators.hierarchy import hierarchy
from trackweave.plans.stages import Stages, scope


def test_only_what_the_result_reads_stays_and_the_session_is_as_before(spark):
    before = {x.key: x.value for x in spark.sql("SET").collect()}
    stages = Stages(spark, "test")
    a, a_path = stages.write(spark.range(5), "a")
    b, b_path = stages.write(a.withColumn("x", F.col("id") * 2), "b")
    assert stages.result(b).count() == 5
    assert not os.path.exists(a_path.removeprefix("file:")) and os.path.exists(b_path.removeprefix("file:"))
    stages.close()
    assert not os.path.exists(stages.root.removeprefix("file:"))
    assert {x.key: x.value for x in spark.sql("SET").collect()} == before


def test_scope_drops_every_stage(spark):
    with scope():
        tree = hierarchy(spark.createDataFrame([("a", 2, 1), ("a", 3, 2)], "m string, node long, parent long"), ["m"])
        files = tree.inputFiles()
        assert tree.count() == 3 and all(os.path.exists(f.removeprefix("file:")) for f in files)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in files)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_equals_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    many = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit(1).alias("parts"))
    one = spark.range(0, 300).select(F.col("id").alias("k"), *([] if how == "left_semi" else [(F.col("id") * 10).alias("v")]))
    assert skew.hot_keys(many, ["k"]).collect()
    many = many.drop("parts")
    found = sorted(map(tuple, skew.spread_join(many, one, ["k"], "id", how).select(*sorted(many.join(one, ["k"], how).columns)).collect()), key=repr)
    want = many.join(one, ["k"], how)
    assert found == sorted(map(tuple, want.select(*sorted(want.columns)).collect()), key=repr)


def test_shuffle_files_go_with_the_write(spark):
    jvm = spark.sparkContext._jvm

    def files():
        found = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b.name() for b in jvm.scala.jdk.javaapi.CollectionConverters.asJava(found) if b.name().startswith("shuffle_")}

    before, stages = files(), Stages(spark, "shuffled")
    stages.write(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "a")
    until = time.time() + 5
    while files() - before and time.time() < until:
        time.sleep(0.1)
    left = files() - before
    stages.close()
    assert not left
