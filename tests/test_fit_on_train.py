"""Train rows are joined once for all passes of a fit, and few rows are ordered in few ranges."""

from pyspark.sql import functions as F

from churnkit.functions.ordering import global_index
from churnkit.operators import split as sp


def test_train_rows_are_kept_during_the_fit(spark):
    raw = spark.createDataFrame([(i, i * 1.5) for i in range(20)], "CustomerID long, x double")
    split = spark.createDataFrame([(i, sp.TEST if i % 5 == 0 else sp.TRAIN) for i in range(20)], "CustomerID long, particao string")
    seen = []

    def fit(train):
        seen.append((train, train.is_cached))
        return train.agg(F.sum("x")).first()[0], train.count()

    assert sp.fit_on_train(raw, split, fit) == (sum(i * 1.5 for i in range(20) if i % 5), 16)
    assert seen[0][1] and not seen[0][0].is_cached


def test_few_rows_get_few_ranges(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.createDataFrame([((k * 37) % 500,) for k in range(500)], "v long")
        got = global_index(df, [F.col("v").desc()], "i")
        assert [r["i"] for r in got.orderBy(F.desc("v")).collect()] == list(range(1, 501))
        assert got.rdd.getNumPartitions() < 64
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
