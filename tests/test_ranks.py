"""Ranks by counting: equal to a window over everything, with hot values cut into id ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnkit.functions.ranks import WHOLE, counting_rank, rank_index
from churnkit.operators import curves as cv
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def hot(spark):
    """One value holds a third of the rows; ids of both signs, crowded and far apart."""
    rng = random.Random(6)
    ids = [*range(4000), *[-(1 << 62) + 7 * k for k in range(500)], *[(1 << 61) + k * (1 << 40) for k in range(500)], *[10 ** 12 + k for k in range(1000)]]
    rng.shuffle(ids)
    rows = [(i, 4242 if k % 3 == 0 else rng.randrange(0, 10001, 50)) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id long, v int").repartition(8)


def want(df, upto=None):
    w = Window.orderBy(F.desc_nulls_last("v"), F.asc_nulls_first("id"))
    out = sorted((r["r"], r["id"], r["v"]) for r in df.select("*", F.row_number().over(w).alias("r")).collect())
    return out if upto is None else out[:upto]


def got(df):
    return sorted((r["r"], r["id"], r["v"]) for r in df.collect())


@pytest.mark.parametrize("limit", [None, 50, 700, 3])
def test_equals_a_window_over_everything(hot, limit):
    assert got(counting_rank(hot, "v", "id", "r", limit=limit)) == want(hot)


def test_best_ranks_only(hot):
    for upto in (1, 10, 1999, 10 ** 6):
        assert got(counting_rank(hot, "v", "id", "r", limit=100, upto=upto)) == want(hot, upto)


def test_hot_value_is_cut_and_every_range_is_small(hot):
    ix = rank_index(hot, "v", "id", limit=100)
    assert all(n <= 100 for *_, n in ix.ranges)
    assert sum(r[4] for r in ix.ranges) == hot.count()
    cut = {r[0] for r in ix.ranges if r[1] != WHOLE}
    assert cut == {4242}
    counts = {r["v"]: r["count"] for r in hot.groupBy("v").count().collect()}
    assert {v for v, n in counts.items() if n > 100} == cut


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, 5), (3, 5), (3, 5), (3, 5), (9, None), (None, None), (1, 7)], "id long, v int")
    assert got_sorted(counting_rank(df, "v", "id", "r", limit=1)) == got_sorted_want(df)
    assert counting_rank(df.where("false"), "v", "id", "r").count() == 0


def got_sorted(df):
    return sorted((r["r"], str(r["id"]), str(r["v"])) for r in df.collect())


def got_sorted_want(df):
    return sorted((r, str(i), str(v)) for r, i, v in want_rows(df))


def want_rows(df):
    w = Window.orderBy(F.desc_nulls_last("v"), F.asc_nulls_first("id"))
    return [(r["r"], r["id"], r["v"]) for r in df.select("*", F.row_number().over(w).alias("r")).collect()]


def test_ranking_has_no_range_exchange_and_no_hot_task(spark, hot):
    scores = hot.select(F.col("id").alias("CustomerID"), (F.col("v") / 10000).alias("prob_churn"), F.lit(1).alias("churn_real"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = cv.risk_ranking(scores, limit=100)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning") == 1
        sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) <= 2 * sum(sizes) / 8  # one value holds a third; eight tasks
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_campaign_over_all_customers(spark, monkeypatch):
    """N = all rows: the same figures whether the head is a bounded top-k or ranked by counting, and nothing row-sized is collected."""
    from churnkit.operators import serving as sv
    from churnkit.plans.context import Chain
    c = Chain(spark, SF_SMALL)
    n = c.reco.count()
    small = [sv.campaign_total(c.campaign_input(n), n, 600.0).first(), *sv.campaign_by_segment(c.campaign_input(n), n, 600.0).collect()]
    monkeypatch.setattr(cv, "TOP_DIRECT_MAX", 10)
    head = c.campaign_input(n)
    plan = head._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "LocalTableScan [CustomerID" not in plan
    large = [sv.campaign_total(head, n, 600.0).first(), *sv.campaign_by_segment(head, n, 600.0).collect()]
    assert small == large and sum(r["clientes"] for r in large[1:]) == n
    with pytest.raises(ValueError):
        sv.campaign_total(c.campaign_input(n + 1), n + 1, 600.0)
