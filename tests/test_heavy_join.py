"""The heavy-key split join equals the plain join, and no task gets a hot key's rows."""

import random

import pytest
from pyspark.sql import functions as F

from churnkit.functions.heavy import heavy_keys, heavy_split_join


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    rows = [(7 if i % 3 == 0 else None if i % 11 == 0 else rng.randrange(400), i, f"v{i % 50}") for i in range(12_000)]
    big = spark.createDataFrame(rows, "k long, event long, v string").repartition(8)
    small = spark.createDataFrame([(k, (k or 0) * 2, "x") for k in [*range(0, 400, 2), 7, 7, None]], "k long, w long, x string")
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_the_plain_join(sides, how):
    big, small = sides
    got, want = heavy_split_join(big, small, "k", ["event"], how), big.join(small, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_heavy_keys_are_few_and_exact(spark, sides):
    big, _ = sides
    got = dict(heavy_keys(big, "k", 20))
    counts = {r["k"]: r["n"] for r in big.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == {k for k, n in counts.items() if n > 600} == {7, None}
    assert all((p - 1) * 600 < counts[k] <= p * 600 for k, p in got.items())
    assert heavy_keys(big.where("false"), "k") == []
    assert heavy_split_join(big.where("false"), sides[1], "k").count() == 0


def test_no_task_holds_a_hot_key(spark, sides):
    big, small = sides
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def largest(joined):
            return max(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()) / joined.count()
        assert largest(big.join(small, "k")) > 0.4
        assert largest(heavy_split_join(big, small, "k", ["event"])) < 0.25  # eight tasks: 0.125 each if even
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_refuses_what_it_cannot_do(sides):
    big, small = sides
    with pytest.raises(ValueError):
        heavy_split_join(big, small, "k", how="full")
    with pytest.raises(ValueError):
        heavy_split_join(big, small.withColumnRenamed("w", "V"), "k")


def test_offers_of_a_hot_customer(spark, tmp_path):
    """offer_events and offer_outcome with one customer holding a third of all events: equal to plain joins, dealt evenly."""
    from churnkit.operators import serving as sv
    from churnkit.sources import fixtures
    n = 9000
    ev = spark.range(n).select(
        F.col("id").alias("event_id"), (F.lit(1_700_000_000) + F.col("id")).cast("timestamp").alias("ts"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 997).cast("long").alias("user_id"),
        F.element_at(F.array(*map(F.lit, ["click", "view", "error", "purchase", "signup"])), (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 41).cast("double").alias("value"))
    ev.write.parquet(str(tmp_path / "events.parquet"))
    segs = spark.range(997).select(F.col("id").alias("CustomerID"), F.concat(F.lit("s"), F.col("id") % 5).alias("segmento"))
    scores = spark.range(0, 997).select(F.col("id").alias("CustomerID"), (F.col("id") / 1000).alias("prob_churn"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = fixtures.offer_events(spark, str(tmp_path), segs)
        assert log.count() == n * 4 // 5
        sizes = [r["count"] for r in log.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) < 0.25 * log.count()
        numbered = log.withColumnRenamed("event_id", "rodada").drop("ts")
        out = sv.offer_outcome(numbered, scores)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == log.count() and max(sizes) < 0.25 * sum(sizes)
        want = {r["CustomerID"]: r["prob_churn"] for r in scores.collect()}
        assert all(r["risco_antes"] == pytest.approx(want[r["CustomerID"]]) for r in out.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
