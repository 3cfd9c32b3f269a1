"""Distributed primitives against their single-task definitions."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnkit.functions.ordering import global_index, index_within, running_sums, trailing_sums
from churnkit.functions.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 3000
    vals = rng.normal(size=n).round(2)          # many ties
    vals[:1000] = 0.5                            # one value holds a third of the rows
    grp = rng.integers(0, 2, size=n)
    rows = [(int(i), float(v), int(g)) for i, (v, g) in enumerate(zip(vals, grp))]
    return spark.createDataFrame(rows, "id long, x double, g int")


def test_global_index_equals_row_number(frame):
    got = global_index(frame, [F.desc("x"), F.asc("id")], "idx", num_partitions=5)
    w = Window.orderBy(F.desc("x"), F.asc("id"))
    ref = frame.select("id", F.row_number().over(w).alias("idx"))
    assert sorted(got.select("id", "idx").collect()) == sorted(ref.collect())


def test_index_within_equals_partitioned_row_number(frame):
    got = index_within(frame, ["g"], [F.asc("x"), F.asc("id")], "rn", num_partitions=4)
    w = Window.partitionBy("g").orderBy(F.asc("x"), F.asc("id"))
    ref = frame.select("id", F.row_number().over(w).alias("rn"))
    assert sorted(got.select("id", "rn").collect()) == sorted(ref.collect())


def test_running_and_trailing_sums(spark):
    rows = [(i, i % 7, (i * 3) % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, a long, b long")
    got = running_sums(df, "k", ["a", "b"], chunk=7).orderBy("k").collect()  # four levels of chunks
    ca = np.cumsum([r[1] for r in rows])
    cb = np.cumsum([r[2] for r in rows])
    assert [r["a_cum"] for r in got] == list(ca)
    assert [r["b_cum"] for r in got] == list(cb)
    tr = trailing_sums(df, "k", ["a"], 8).orderBy("k").collect()
    a = np.array([r[1] for r in rows])
    assert [r["a_win"] for r in tr] == [int(a[max(0, i - 7): i + 1].sum()) for i in range(1000)]


@pytest.mark.parametrize("max_bracket", [100, 200_000])
def test_exact_quantiles_narrowing(frame, max_bracket):
    qs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(frame, {"x": qs, "id": [0.5]}, max_bracket=max_bracket, accuracy=100)
    xs = np.array([r["x"] for r in frame.select("x").collect()])
    assert np.allclose(got["x"], np.quantile(xs, qs), rtol=0, atol=1e-12)
    assert got["id"] == [1499.5]


def test_exact_quantiles_matches_pandas_median(spark):
    import pandas as pd
    vals = [3.0, None, 1.0, 7.0, 2.0, None, 9.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert exact_quantiles(df, {"x": [0.5]})["x"][0] == pd.Series(vals).median()


def test_quantiles_with_a_hot_value(spark, monkeypatch):
    """A value that holds a third of the rows: no array reaches the driver, passes stay few."""
    from churnkit.functions import quantiles as qt
    n = 90_000
    df = spark.range(n).selectExpr("case when id % 3 = 0 then 7.0 else cast((id * 7919) % 10007 as double) / 100 end as x").persist()
    xs = np.sort(df.toPandas()["x"].to_numpy())
    read, rounds = [], []
    one, two = qt._read, qt._narrow
    monkeypatch.setattr(qt, "_read", lambda d, small: (read.extend(r.inside for r in small), one(d, small)))
    monkeypatch.setattr(qt, "_narrow", lambda d, todo, acc: (rounds.append(len(todo)), two(d, todo, acc)))
    for qs in ([0.0, 0.02, 0.069, 0.07, 0.2, 0.35, 0.402, 0.41, 0.9, 1.0], [0.5], [1 / 3]):
        read.clear()
        rounds.clear()
        got = exact_quantiles(df, {"x": qs}, max_bracket=50, accuracy=500)["x"]
        assert np.allclose(got, np.quantile(xs, qs), rtol=0, atol=1e-12)
        assert all(r <= 50 for r in read) and len(rounds) <= 6
    source = __import__("inspect").getsource(qt)
    assert "collect_list" not in source and "n_rows" not in source


def test_global_index_is_stable_when_recomputed(frame):
    order = [F.asc("x"), F.asc("id")]
    a = global_index(frame, order, "idx", num_partitions=6).select("id", "idx")
    b = global_index(frame.repartition(3), order, "idx", num_partitions=6).select("id", "idx")
    first = sorted(a.collect())
    assert first == sorted(a.collect())          # same checkpointed numbering on re-read
    assert first == sorted(b.collect())          # independent of the input partitioning
