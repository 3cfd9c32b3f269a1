"""Keyed stream state: equal to the batch operators when offers arrive twice, late and over a restart."""

import random

import pytest
from pyspark.sql import functions as F

from churnkit.operators import policy as pol
from churnkit.operators.segments import SEGMENTS
from churnkit.streaming import policy_state as ps

ACTIONS = [a for a, _, _ in pol.ACTIONS]


@pytest.fixture
def log():
    """2,000 offers, one a minute; half of them of one segment."""
    rng = random.Random(2)
    return [(10_000 + k, 1_700_000_000 + k * 60, k + 1, SEGMENTS[0] if k % 2 else rng.choice(SEGMENTS), rng.choice(ACTIONS), rng.randrange(2)) for k in range(2000)]


def deliver(spark, rows, path):
    df = spark.createDataFrame(rows, "event_id long, s long, rodada long, segmento string, acao string, aceitou int")
    df.select("event_id", F.timestamp_seconds("s").alias("ts"), "rodada", "segmento", "acao", "aceitou").coalesce(1).write.mode("append").parquet(path)


def want(spark, rows):
    df = spark.createDataFrame([(r[2], 0, *r[3:]) for r in rows], "rodada long, CustomerID long, segmento string, acao string, aceitou int")
    counts = sorted(map(tuple, pol.policy_counts(df).collect()))
    return counts, sorted((r["rodada"], r["taxa_aceite"]) for r in pol.learning_curve(df).collect())


def got(spark, out):
    return sorted(map(tuple, ps.state_counts(spark, out).collect())), sorted(map(tuple, ps.state_curve(spark, out).collect()))


def test_late_and_repeated_offers_and_a_restart(spark, log, tmp_path):
    d, out, ck = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "ck")
    rng = random.Random(1)
    parts = [log[:700], log[900:1500], log[700:900], log[650:950], log[1500:]]  # the third comes late, the fourth again
    for p in parts[:3]:
        deliver(spark, rng.sample(p, len(p)), d)
    ps.run_policy_state(spark, d, out, ck, watermark="2 days", files_per_trigger=1)
    first = log[:1500]
    assert got(spark, out) == want(spark, first)
    for p in parts[3:]:
        deliver(spark, p, d)
    ps.run_policy_state(spark, d, out, ck, watermark="2 days", files_per_trigger=1)  # goes on from the checkpoint
    assert got(spark, out) == want(spark, log)
    ps.run_policy_state(spark, d, out, ck, watermark="2 days")  # nothing new
    assert got(spark, out) == want(spark, log)


def test_blocks_that_left_the_ring_take_late_rows(spark, log, tmp_path):
    d, out, ck = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "ck")
    for p in (log[20:1900], log[1900:], log[:20]):  # the first rounds come last, 30 blocks later
        deliver(spark, p, d)
    ps.run_policy_state(spark, d, out, ck, watermark="2 days", files_per_trigger=1)
    assert got(spark, out) == want(spark, log)
    kinds = {r["tipo"] for r in spark.read.parquet(f"{out}/batch-*").select("tipo").distinct().collect()}
    assert kinds == {ps.COUNT, ps.BLOCK, ps.LATE}


def test_tasks_add_up_before_the_state(spark, log):
    import pandas as pd
    df = pd.DataFrame([(r[3], r[4], (r[2] - 1) // 50, r[5]) for r in log], columns=["segmento", "acao", "bloco", "aceitou"])
    out = pd.concat(ps._partial(iter([df, df.iloc[:0]])))
    assert len(out) <= 40 * len(SEGMENTS) * len(ACTIONS) and out["n"].sum() == 2000 and out["aceites"].sum() == sum(r[5] for r in log)


def test_a_delivery_is_one_batch_and_state_is_as_wide_as_the_cores(spark, log, tmp_path):
    import os
    d, out, ck = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "ck")
    df = spark.createDataFrame(log, "event_id long, s long, rodada long, segmento string, acao string, aceitou int")
    df = df.select("event_id", F.timestamp_seconds("s").alias("ts"), "rodada", "segmento", "acao", "aceitou").repartitionByRange(40, "rodada")
    third = F.col("rodada") % 3
    files = ps.deliver(df, [third == 0, third == 2, third == 1, third == 2], d)
    assert files == 1 and len([f for f in os.listdir(d) if f.startswith("part-")]) == 4
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        ps.run_policy_state(spark, d, out, ck, watermark="3650 days", files_per_trigger=files)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got(spark, out) == want(spark, log)
    for step in os.listdir(f"{ck}/state"):
        assert len([x for x in os.listdir(f"{ck}/state/{step}") if x.isdigit()]) <= spark.sparkContext.defaultParallelism
