"""Ranks by a score of few values and a unique id, from counts instead of a sort of the whole table.

How many rows each score value holds says where its ranks start.  A value that
holds many rows is cut into ranges of ids, by counting the blocks of ids that share
their high bits and cutting full blocks again.  Every range knows its first
rank, so the rows are numbered range by range and no task holds a hot value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_VALUE, _SHIFT, _BLOCK, _START = "_ck_value", "_ck_shift", "_ck_block", "_ck_start"
#: a block that is too full is cut into so many
CUT_BITS = 6
WHOLE = 64  # the shift of a value that is not cut


@dataclass(frozen=True)
class RankIndex:
    """Where ranks start: rows (value, shift, block, start, n); ``start`` ranks lie before the range."""

    ranges: list[tuple[int | None, int, int, int, int]]
    limit: int


def rank_index(rows: DataFrame, value: str, key: str, limit: int | None = None) -> RankIndex:
    """Counts ``rows`` by ``value`` (an integer with few values, descending) and cuts what holds over ``limit`` rows.

    ``limit`` is half a shuffle partition's share of the rows by default (4,096 at
    least), so at most twice as many values as partitions are cut; the driver
    holds one row per value and at most 64 per cut and round.  Each round reads
    only the rows of full ranges and cuts them by six more bits of the id; a range
    of a single id is never cut.  Null values come last, null ids first.
    """
    spark = rows.sparkSession
    ident = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    counts = rows.groupBy(F.col(value).cast("long").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ident).alias("lo"), F.max(ident).alias("hi")).collect()  # one row per value
    total = sum(r["n"] for r in counts)
    limit = limit or max(4096, -(-total // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    done: list[tuple[int | None, int, int, int]] = []
    open_: list[tuple[int | None, int, int]] = []  # (value, shift, block) to cut; a block is its ids >> shift
    for r in counts:
        same = (r["lo"] ^ r["hi"]).bit_length()
        if r["n"] <= limit or not same:
            done.append((r["v"], WHOLE, 0, r["n"]))
        elif r["lo"] >> same == r["hi"] >> same:
            open_.append((r["v"], same, r["lo"] >> same))
        else:  # ids of both signs
            open_ += [(r["v"], 63, -1), (r["v"], 63, 0)]
    while open_:
        todo = spark.createDataFrame(open_, f"{_VALUE} long, {_SHIFT} int, {_BLOCK} long")
        found = []
        for shift in sorted({s for _, s, _ in open_}):
            finer = max(0, shift - CUT_BITS)
            some = F.broadcast(todo.where(F.col(_SHIFT) == shift))  # bounded as above
            cut = rows.select(F.col(value).cast("long").alias("v"), ident.alias("i")).join(
                some, F.col("v").eqNullSafe(F.col(_VALUE)) & (F.shiftright("i", shift) == F.col(_BLOCK)))
            got = cut.groupBy("v", F.shiftright("i", finer).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
            found += [(r["v"], finer, r["b"], r["n"]) for r in got]
        done += [x for x in found if x[3] <= limit or x[1] == 0]
        open_ = [x[:3] for x in found if x[3] > limit and x[1] > 0]
    out, start = [], 0
    for v, shift, block, n in sorted(done, key=lambda x: (x[0] is None, -(x[0] or 0), x[2] << x[1] if x[1] < WHOLE else 0)):
        out.append((v, shift, block, start, n))
        start += n
    return RankIndex(out, limit)


def counting_rank(rows: DataFrame, value: str, key: str, name: str = "rank", index: RankIndex | None = None,
                  limit: int | None = None, upto: int | None = None) -> DataFrame:
    """``rows`` with ``name`` = 1-based position by (``value`` descending, ``key`` ascending), one hash shuffle.

    ``value`` is an integer column of few values, ``key`` an integer column of
    unique ids (rows that share both are numbered in any order).  ``upto`` keeps
    the best ranks only: ranges that start behind it are dropped before the shuffle.
    """
    index = index or rank_index(rows, value, key, limit)
    spark = rows.sparkSession
    kept = [r[:4] for r in index.ranges if upto is None or r[3] < upto]
    ident = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    shifts = sorted({s for _, s, _, _ in kept})
    parts = []
    for shift in shifts or [WHOLE]:
        some = spark.createDataFrame([(v, b, s0) for v, s, b, s0 in kept if s == shift], f"{_VALUE} long, {_BLOCK} long, {_START} long")
        block: Column = F.lit(0) if shift == WHOLE else F.shiftright(ident, shift)
        parts.append((some, block))
    out = rows
    starts = []
    for k, (some, block) in enumerate(parts):  # seldom more than two: whole values and one size of block
        at = some.select(*[F.col(c).alias(f"{c}{k}") for c in some.columns])
        out = out.join(F.broadcast(at), F.col(value).cast("long").eqNullSafe(F.col(f"{_VALUE}{k}")) & (block == F.col(f"{_BLOCK}{k}")), "left")
        starts.append(F.col(f"{_START}{k}"))
    out = out.withColumn(_START, F.coalesce(*starts) if len(starts) > 1 else starts[0]).where(F.col(_START).isNotNull())
    here = Window.partitionBy(_START).orderBy(F.asc_nulls_first(key))
    out = out.withColumn(name, (F.col(_START) + F.row_number().over(here)).cast("long")).select(*rows.columns, name)
    return out if upto is None else out.where(F.col(name) <= upto)
