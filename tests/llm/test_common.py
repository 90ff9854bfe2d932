from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from taleframe.llm import common
from taleframe.llm.common import noted, remove, salted_join, shared_dir, stage

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_staged_table_equals_its_frame_and_settings_come_back(spark):
    before = spark.conf.get(CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    with noted() as paths:
        held = stage(df, "sums")
    assert spark.conf.get(CLEANUP, None) == before and len(paths) == 1
    assert sorted(held.collect()) == sorted(df.collect()) and held.schema == df.schema
    remove(spark, paths)


def test_a_failed_write_puts_the_setting_back(spark):
    before = spark.conf.get(CLEANUP, None)
    with pytest.raises(Exception, match="no rows"):
        stage(spark.range(3).select(F.raise_error(F.lit("no rows")).alias("x")), "none")
    assert spark.conf.get(CLEANUP, None) == before


def test_a_cluster_must_name_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


@pytest.mark.parametrize("light", [1000, 2])
def test_salted_join_equals_a_join(spark, light, monkeypatch):
    monkeypatch.setattr(common, "LIGHT", light)
    monkeypatch.setattr(common, "HEAVY", 5)
    rows = [(i, "hot" if i % 3 else f"k{i % 50}", i % 2) for i in range(600)] + [(600, None, 0), (601, "alone", 1), (601, "hot", 1), (601, "hot", 1)]
    facts = spark.createDataFrame(rows, "id long, k string, b int")
    per_key = stage(facts.where("k <> 'alone'").groupBy("k", "b").agg(F.count("*").alias("n"), F.min("id").alias("least")), "per-key")
    got = salted_join(facts, per_key, ["k", "b"], "n", "id")
    assert got.columns == ["k", "b", "id", "n", "least"]
    assert sorted(got.collect()) == sorted(facts.join(per_key, ["k", "b"]).collect())
    assert salted_join(facts, per_key.limit(0), ["k", "b"], "n", "id").count() == 0 == salted_join(facts.limit(0), per_key, ["k", "b"], "n", "id").count()


def test_salted_join_deals_a_heavy_key_to_many_tasks(spark):
    facts = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    per_key = stage(facts.groupBy("k").agg(F.count("*").alias("n")), "per-key")
    # small tables would be broadcast, or their partitions put together
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        parts = salted_join(facts, per_key, ["k"], "n", "id").where("k = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in parts) == 10_000 and len(parts) > 1 and max(r["count"] for r in parts) < 9_000
