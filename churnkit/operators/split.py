"""Split, folds, class weights and standardisation.

The stratified order is md5(key || '-seed') within each class; positions
within a class come from a range-partitioned global index minus the class
start (``index_within``), never from a window holding a whole class.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.columns import fixed
from churnkit.functions.ordering import index_within

SEED = 42
TEST_FRACTION = 0.2
TEST, TRAIN = "teste", "treino"
LEAST_PARTS = 4  # partitions that a frame may have however few its rows are
PASS_ROWS = 5_000  # rows a task of what is learned in a few dozen passes


def stratified_order(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    base = df.select(key, F.col(label).alias("_y"), h.alias("_h"))
    ranked = index_within(base, ["_y"], [F.asc("_h"), F.asc(key)], "_rn")
    sizes = ranked.groupBy("_y").agg(F.count(F.lit(1)).alias("_ny"))
    return ranked.join(F.broadcast(sizes), "_y")


def _n_test(ny: F.Column, frac: float) -> F.Column:
    """round(frac * n) half-up, in integers."""
    q = Fraction(frac).limit_denominator(10_000)
    return F.floor((ny * (2 * q.numerator) + q.denominator) / F.lit(2 * q.denominator)).cast("long")


def split_stratified(df: DataFrame, key: str = "CustomerID", label: str = "Churn",
                     test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """M1: (key, label, particao, ordem_estrato); round(f * n_class) rows of each class go to test."""
    o = stratified_order(df, key, label, seed)
    part = F.when(F.col("_rn") <= _n_test(F.col("_ny"), test_fraction), TEST).otherwise(TRAIN)
    return o.select(key, F.col("_y").alias(label), part.alias("particao"),
                    F.col("_rn").alias("ordem_estrato"))


def split_align(other: DataFrame, split: DataFrame, part: str = TEST, key: str = "CustomerID") -> DataFrame:
    """M2: restrict another table to one side of the split (semi join on the key)."""
    return other.join(split.where(F.col("particao") == part).select(key), key, "left_semi")


def fit_on_train(other: DataFrame, split: DataFrame, fit: Callable[[DataFrame], Any], key: str = "CustomerID") -> Any:
    """What ``fit`` learns from the train rows, which are joined once and kept for all its passes, in no more
    partitions than they need."""
    parts = max(LEAST_PARTS, -(-split.count() // PASS_ROWS))
    train = split_align(other, split, TRAIN, key).coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit(train)
    finally:
        train.unpersist()


def packed(df: DataFrame, rows_a_task: int, key: str = "CustomerID") -> DataFrame:
    """``df`` written to the checkpoint folder, in no more partitions than its rows need (whole keys, in order).

    An iterative fit runs a job per step over every partition, so many small ones cost it more than their rows.
    """
    held = df.checkpoint(eager=True)
    parts = max(LEAST_PARTS, -(-held.count() // rows_a_task))
    if held.rdd.getNumPartitions() <= parts:
        return held
    return held.repartition(parts, key).sortWithinPartitions(key).checkpoint(eager=True)


def folds_stratified(split: DataFrame, k: int = 5, key: str = "CustomerID",
                     label: str = "Churn", test_fraction: float = TEST_FRACTION) -> DataFrame:
    """M3: fold = (position among the class's train rows - 1) mod k."""
    tr = split.where(F.col("particao") == TRAIN)
    sizes = split.groupBy(label).agg(F.count(F.lit(1)).alias("_ny"))
    j = tr.join(F.broadcast(sizes), label)
    pos = F.col("ordem_estrato") - _n_test(F.col("_ny"), test_fraction)
    return j.select(key, label, F.pmod(pos - 1, F.lit(k)).cast("int").alias("fold"))


def class_weights(train: DataFrame, label: str = "Churn") -> DataFrame:
    """M4: balanced weight n / (2 n_c) per class and scale_pos_weight = n0 / n1."""
    c = train.groupBy(F.col(label).cast("int").alias("classe")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("classe") == 0, F.col("n"))).alias("n0"),
                F.sum(F.when(F.col("classe") == 1, F.col("n"))).alias("n1")).first()
    return c.select("classe", "n",
                    fixed(F.lit(float(tot["t"])) / (F.lit(2.0) * F.col("n")), 6).alias("peso"),
                    fixed(F.lit(float(tot["n0"] or 0)) / F.lit(float(tot["n1"] or 1)), 6)
                    .alias("scale_pos_weight"))


def weight_column(df: DataFrame, weights: DataFrame, label: str = "Churn", name: str = "peso") -> DataFrame:
    """Attach the class weight (two-row table, broadcast)."""
    w = weights.select(F.col("classe").alias("_c"), F.col("peso").alias(name))
    return df.join(F.broadcast(w), F.col(label).cast("int") == F.col("_c")).drop("_c")


def standardise_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M5: mean and population std of each column on the fit rows (one pass)."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m{i}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")]
    row = train.agg(*aggs)
    body = ", ".join(f"'{c}', m{i}, s{i}" for i, c in enumerate(columns))
    return row.selectExpr(f"stack({len(columns)}, {body}) AS (coluna, media, desvio)")


def standardise(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Apply (x - mean) / std with fitted stats (0 when std = 0)."""
    s = {r["coluna"]: (r["media"], r["desvio"]) for r in stats.collect()}
    out = [F.col(c) for c in df.columns if c not in columns]
    for c in columns:
        m, d = s[c]
        out.append(((F.col(c) - F.lit(m)) / F.lit(d if d else 1.0)).alias(c))
    return df.select(*out)
