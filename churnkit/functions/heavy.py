"""Joins whose big side has a few keys that hold a large share of its rows.

The keys of the big side are counted first.  A key above a set share of the rows
is heavy: its rows are dealt over as many parts as keep each below that share,
and the few matching rows of the other side are repeated once per part.  All
other keys are joined as they would be anyway; both kinds go through one join, on
the key and the part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

_PART, _PARTS = "_ck_part", "_ck_parts"
#: join types that keep or drop rows of the big side by itself, so repeating the other side can't repeat them
KINDS = ("inner", "left", "left_outer", "left_semi", "left_anti")


def heavy_keys(big: DataFrame, key: str, slots: int | None = None) -> list[tuple[object, int]]:
    """(key, parts) of every key that holds more than 1 / ``slots`` of the rows.

    ``slots`` is four times the shuffle partitions by default.  Fewer than
    ``slots`` keys can hold more than that share, so the list is bounded whatever
    the table's size.  One job: the keys are counted (combined before the shuffle)
    and the largest ``slots`` counts are kept; the number of all rows is observed
    on the way.  A null key is a key like any other.
    """
    n = slots or 4 * int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = Observation()
    counts = big.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum("n").alias("all"))
    top = counts.orderBy(F.desc("n")).limit(n).collect()
    share = (seen.get["all"] or 0) / n if top else 0
    return [(r["k"], -int(-r["n"] // share)) for r in top if r["n"] > share]


def heavy_split_join(big: DataFrame, small: DataFrame, key: str, deal_by: Sequence[str] | None = None, how: str = "inner",
                     slots: int | None = None, heavy: list[tuple[object, int]] | None = None) -> DataFrame:
    """``big.join(small, key, how)`` in which no key of ``big`` stays in one task.

    ``big`` stands on the left of the join; ``how`` is one of ``KINDS``.  The rows
    of a heavy key are dealt by a hash of ``deal_by`` (columns that tell its rows
    apart; all columns by default), so a row that is computed again after a loss
    goes to the same part.  Rows that are equal in those columns stay together.
    Heavy null keys are dealt like others and match nothing.  ``heavy`` is a list
    that ``heavy_keys`` gave (counted here if it isn't given).  Columns and their
    order are those of the plain join; a column of ``small`` whose name ``big`` has
    too is an error, as it would be ambiguous.
    """
    if how not in KINDS:
        raise ValueError(f"how must be one of {KINDS}")
    both = {c.lower() for c in big.columns} & {c.lower() for c in small.columns} - {key.lower()}
    if both and how not in ("left_semi", "left_anti"):
        raise ValueError(f"both sides have the columns {sorted(both)}")
    heavy = heavy_keys(big, key, slots) if heavy is None else heavy
    if not heavy:
        return big.join(small, key, how)
    spark = big.sparkSession
    table = F.broadcast(spark.createDataFrame(heavy, f"_ck_key {big.schema[key].dataType.simpleString()}, {_PARTS} int"))  # at most ``slots`` rows

    def parts(side: DataFrame) -> DataFrame:
        return side.join(table, F.col(key).eqNullSafe(F.col("_ck_key")), "left").drop("_ck_key")

    row = [F.col(f"`{c}`") for c in (deal_by or big.columns)]
    dealt = parts(big).withColumn(_PART, _dealt(row)).drop(_PARTS)
    repeated = parts(small).withColumn(_PART, F.explode(F.when(F.col(_PARTS).isNull(), F.array(F.lit(0)))
                                                         .otherwise(F.sequence(F.lit(0), F.col(_PARTS) - 1)))).drop(_PARTS)
    return dealt.join(repeated, [key, _PART], how).drop(_PART)


def _dealt(row: Sequence[Column]) -> Column:
    return F.when(F.col(_PARTS).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*row), F.col(_PARTS).cast("long")).cast("int"))
