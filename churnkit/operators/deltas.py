"""Score counts kept up to date by signed rows (E1-E8 without a recount).

The curves read nothing but counts per score (at most 10,001 rows).  When some
customers' scores or labels change, each adds a row of -1 at its old score and
one of +1 at its new score; only the changed customers are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.operators.curves import to_bp


def changes(state: DataFrame, new: DataFrame, key: str = "CustomerID", prob: str = "prob_churn", label: str = "churn_real") -> DataFrame:
    """(key, old_prob, old_label, new_prob, new_label) of the customers in ``new``.

    ``new`` holds the changed customers once each, a null score for one that
    leaves; ``state`` is the score table before.  A customer that ``state`` lacks is
    new; one that leaves without having been there changes nothing.
    """
    now = new.select(key, F.col(prob).alias("new_prob"), F.col(label).alias("new_label"))
    was = state.select(key, F.col(prob).alias("old_prob"), F.col(label).alias("old_label"))
    return now.join(was, key, "left").select(key, "old_prob", "old_label", "new_prob", "new_label")


def score_deltas(changed: DataFrame) -> DataFrame:
    """(prob_bp, pos, neg): signed counts of a change set, one row per score at most."""
    def side(prob: str, label: str, sign: int) -> DataFrame:
        y = F.col(label) == 1
        return changed.where(F.col(prob).isNotNull()).select(
            to_bp(prob).alias("prob_bp"), F.when(y, sign).otherwise(0).cast("long").alias("pos"),
            F.when(y, 0).otherwise(sign).cast("long").alias("neg"))
    both = side("old_prob", "old_label", -1).unionByName(side("new_prob", "new_label", 1))
    return both.groupBy("prob_bp").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos <> 0 or neg <> 0")


def apply_deltas(counts: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Score counts after the change sets, in any order; scores without rows go.

    A count below zero means that a row was retracted which was never counted, and
    is an error.
    """
    rows = counts.select("prob_bp", "pos", "neg")
    for d in deltas:
        rows = rows.unionByName(d.select("prob_bp", "pos", "neg"))
    total = rows.groupBy("prob_bp").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    broken = (F.col("pos") < 0) | (F.col("neg") < 0)
    checked = [F.when(broken, F.raise_error(F.concat(F.lit("count below zero at score "), F.col("prob_bp").cast("string"))).cast("long"))
               .otherwise(F.col(c)).alias(c) for c in ("pos", "neg")]
    return total.where("pos <> 0 or neg <> 0").select("prob_bp", *checked)


def next_state(state: DataFrame, new: DataFrame, key: str = "CustomerID") -> DataFrame:
    """The score table after a change set (rows of a null score leave)."""
    cols = [key, "prob_churn", "churn_real"]
    kept = state.select(*cols).join(new.select(key), key, "left_anti")
    return kept.unionByName(new.where(F.col("prob_churn").isNotNull()).select(*cols))
