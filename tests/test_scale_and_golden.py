"""Published reference arithmetic, skew balance and streaming increments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.operators import curves as cv
from churnkit.operators import policy as pol


def test_reference_confusion_arithmetic(spark):
    # confusion at .25 published for the first model: TN 1,304 FP 5,964 FN 166 TP 2,776
    sc = spark.createDataFrame([(3000, 2776, 5964), (1000, 166, 1304)], "prob_bp int, pos long, neg long")
    m = cv.metrics_at(sc, 0.25).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (2776, 5964, 1304, 166)
    assert m["recall"] == 0.9436 and m["precision"] == 0.3176 and m["abordados"] == 8740
    assert round(m["f1"], 3) == 0.475


def test_range_partitions_balanced_under_a_hot_score(spark):
    n = 30_000
    rng = np.random.default_rng(5)
    probs = rng.integers(0, 10_000, n) / 10_000
    probs[: n // 3] = 0.4242                      # one score holds a third of the rows
    df = spark.createDataFrame([(int(i), float(p), int(i % 2)) for i, p in enumerate(probs)],
                               "CustomerID long, prob_churn double, churn_real int")
    order = [F.desc("prob_churn"), F.asc("CustomerID")]
    sizes = [r["n"] for r in df.repartitionByRange(8, *order)
             .groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 2 * n / 8
    ranked = cv.risk_ranking(df)
    assert ranked.agg(F.min("rank_risco"), F.max("rank_risco"), F.countDistinct("rank_risco")).first() == (1, n, n)


def test_stream_counters_grow_with_batches(spark, tmp_path):
    from churnkit.streaming.policy_stream import LOG_SCHEMA, read_counters, run_policy_stream
    log_dir, out, ck = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "ck")
    rows1 = [(1, "Perfil geral", "desconto", 1), (2, "Perfil geral", "bonus", 0)]
    rows2 = [(3, "Perfil geral", "desconto", 0)]
    spark.createDataFrame(rows1, LOG_SCHEMA).write.mode("append").parquet(log_dir)
    run_policy_stream(spark, log_dir, out, ck)
    first = {(r["segmento"], r["acao"]): (r["tentativas"], r["aceites"]) for r in read_counters(spark, out).collect()}
    assert first == {("Perfil geral", "desconto"): (1, 1), ("Perfil geral", "bonus"): (1, 0)}
    spark.createDataFrame(rows2, LOG_SCHEMA).write.mode("append").parquet(log_dir)
    run_policy_stream(spark, log_dir, out, ck)      # restarts from the checkpoint, reads only the new file
    second = {(r["segmento"], r["acao"]): (r["tentativas"], r["aceites"]) for r in read_counters(spark, out).collect()}
    assert second[("Perfil geral", "desconto")] == (2, 1)
    batch = pol.policy_counts(spark.read.parquet(log_dir))
    got = {(r["segmento"], r["acao"]): (r["tentativas"], r["aceites"]) for r in batch.where("tentativas > 0").collect()}
    assert got == second                            # R13 = R5 on the same rows


def test_an_unfinished_stream_is_an_error(spark, tmp_path):
    from churnkit.streaming.policy_stream import LOG_SCHEMA, run_policy_stream
    log_dir = str(tmp_path / "log")
    spark.createDataFrame([(i, "Perfil geral", "bonus", 0) for i in range(40)], LOG_SCHEMA).repartition(40).write.parquet(log_dir)
    with pytest.raises(TimeoutError):
        run_policy_stream(spark, log_dir, str(tmp_path / "out"), str(tmp_path / "ck"), files_per_trigger=1, timeout=0.2)


def test_thompson_draws_belong_to_the_customer(spark):
    from churnkit.operators.segments import SEG_GENERAL
    log = spark.createDataFrame([(i, SEG_GENERAL, a, i % 2) for i, a in enumerate(["suporte", "bonus", "desconto"] * 20)],
                                "CustomerID long, segmento string, acao string, aceitou int")
    counts = pol.policy_counts(log)
    draws = []
    for parts in (1, 4, 16):
        segs = spark.range(500).selectExpr("id * 3 - 40 as CustomerID", f"'{SEG_GENERAL}' as segmento").repartition(parts)
        draws.append(sorted(map(tuple, pol.thompson_assign(segs, counts).select("CustomerID", "acao", "amostra").collect())))
    assert draws[0] == draws[1] == draws[2] and len({d[2] for d in draws[0]}) == 500


def test_thompson_prefers_the_clear_winner(spark):
    from churnkit.operators.segments import SEG_GENERAL
    rows = ([(i, 1, SEG_GENERAL, "suporte", 1) for i in range(400)]
            + [(400 + i, 1, SEG_GENERAL, "desconto", 0) for i in range(400)])
    log = spark.createDataFrame([(i + 1, c, s, a, y) for i, (_, c, s, a, y) in enumerate(rows)],
                                "rodada long, CustomerID long, segmento string, acao string, aceitou int")
    segs = spark.createDataFrame([(i, SEG_GENERAL) for i in range(500)], "CustomerID long, segmento string")
    out = pol.thompson_assign(segs, pol.policy_counts(log))
    picks = {r["acao"]: r["n"] for r in out.groupBy("acao").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(picks.values()) == 500
    assert picks.get("suporte", 0) > 400          # Beta(401, 1) dominates the untried Beta(1, 1)


@pytest.mark.parametrize("direct_max", [10_000, 5])
def test_top_ranked_equals_full_ranking_head(spark, direct_max):
    rng = np.random.default_rng(9)
    probs = (rng.integers(0, 50, 2000) / 100).tolist()          # heavy ties
    df = spark.createDataFrame([(int(i), float(p), int(i % 3 == 0)) for i, p in enumerate(probs)],
                               "CustomerID long, prob_churn double, churn_real int")
    full = cv.risk_ranking(df).where("rank_risco <= 37").collect()
    top = cv.top_ranked(df, 37, direct_max=direct_max).collect()
    assert sorted(map(tuple, full)) == sorted(map(tuple, top))


def test_draws_follow_the_beta_distribution():
    keys = np.arange(200_000, dtype=np.uint64)
    for a, b in ((1.0, 1.0), (3.0, 7.0), (401.0, 1.0), (50.0, 60.0)):
        x = pol.beta_draws(np.full(len(keys), a), np.full(len(keys), b), keys, 42, 1)
        mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
        assert abs(x.mean() - mean) < 5 * np.sqrt(var / len(x)) and abs(x.var() / var - 1) < 0.03
        assert 0 < x.min() and x.max() <= 1
    half = np.sort(pol.beta_draws(np.ones(len(keys)), np.ones(len(keys)), keys, 7, 0))  # uniform
    assert np.abs(half - (np.arange(len(half)) + 0.5) / len(half)).max() < 0.005
    some = pol.beta_draws(np.full(3, 2.0), np.full(3, 5.0), np.array([5, 9, 5], np.uint64), 42, 1)
    alone = pol.beta_draws(np.full(1, 2.0), np.full(1, 5.0), np.array([9], np.uint64), 42, 1)
    assert some[0] == some[2] and some[1] == alone[0] != some[0]

