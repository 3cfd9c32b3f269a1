"""Model frames: partitions follow the rows, not the shuffle setting; rows stay, whole keys together."""

import pytest
from pyspark.sql import functions as F

from churnkit.operators import split as sp
from churnkit.plans.context import ModelChain


def frame(spark, n, parts, keys=None):
    k = F.col("id") % keys if keys else F.col("id")
    return spark.range(n).select(F.when(F.col("id") != 7, k).alias("CustomerID"), (F.col("id") * 1.5).alias("x")).repartition(parts)


@pytest.mark.parametrize("n, parts, rows_a_task, most", [(1000, 60, 100, 10), (1000, 60, 5000, 4), (1000, 6, 100, 6), (0, 9, 10, 9)])
@pytest.mark.parametrize("keys", [None, 40])
def test_partitions_follow_the_rows(spark, n, parts, rows_a_task, most, keys):
    df = frame(spark, n, parts, keys)
    got = sp.packed(df, rows_a_task)
    assert got.rdd.getNumPartitions() <= most
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


def test_keys_stay_together_and_sorted(spark):
    parts = sp.packed(frame(spark, 1000, 60, 90), 100).rdd.glom().collect()
    seen = [[r["CustomerID"] if r["CustomerID"] is not None else -1 for r in p] for p in parts]
    assert all(p == sorted(p) for p in seen)
    assert sum(len(set(p)) for p in seen) == 91


def test_train_and_test_frames_are_packed(spark, monkeypatch):
    n = 3000
    split = spark.range(n).select(F.col("id").alias("CustomerID"), (F.col("id") % 3 == 0).cast("int").alias("Churn"),
                                  F.when(F.col("id") % 5 == 0, sp.TEST).otherwise(sp.TRAIN).alias("particao"),
                                  (F.col("id") + 1).alias("ordem_estrato"))
    wide = spark.range(n).select(F.col("id").alias("CustomerID"), F.rand(1).alias("x")).repartition(50, "CustomerID")
    monkeypatch.setattr(ModelChain, "split", split)
    monkeypatch.setattr(ModelChain, "labelled", wide)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, rows in (("train", 2400), ("train_search", 2400), ("test", 600)):
            got = getattr(ModelChain(spark, f"/packed-{name}"), name)
            assert got.count() == rows
            assert got.rdd.getNumPartitions() <= 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
