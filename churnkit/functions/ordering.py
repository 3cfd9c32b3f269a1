"""Total orders and prefix sums without a single-partition window.

``Window`` without ``partitionBy`` pulls a whole table into one task.  The
helpers here use the two-level form instead: range-partition on the sort
key, number rows inside each partition, and add a per-partition offset taken
from a table with one row per partition (bounded by the partition count).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PID, _MID, _OFF, _CNT = "_ck_pid", "_ck_mid", "_ck_off", "_ck_cnt"


def global_index(df: DataFrame, order: Sequence[Column], name: str = "row_idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row in ``order``.

    ``order`` must be a total order (end it with a unique key) for the
    numbering to be deterministic.  The numbered rows are checkpointed to the
    shared checkpoint folder so that the partition counts and the rows come
    from the same materialised partitioning, also after an executor loss.
    """
    from churnkit.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    # without a number, small inputs get few ranges (adaptive execution merges neighbours, in order)
    ranges = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    ranged = (ranges
                .sortWithinPartitions(*order)
                .withColumn(_PID, F.spark_partition_id())
                .withColumn(_MID, F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy(_PID).agg(F.count(F.lit(1)).alias(_CNT))
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, F.coalesce(F.sum(_CNT).over(w), F.lit(0)).alias(_OFF))
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (ranged.join(F.broadcast(offsets), _PID)
                  .withColumn(name, (F.col(_OFF) + local + 1).cast("long"))
                  .drop(_PID, _MID, _OFF))


def index_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column],
                 name: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by groups order by order)`` for few,
    possibly huge groups (e.g. the two classes of a target).

    One global numbering over (groups, order) minus the start of each group;
    no task ever holds a whole group.  The group table must be small (it is
    broadcast); its size is the number of distinct group keys.
    """
    g = list(groups)
    idx = global_index(df, [F.col(c).asc() for c in g] + list(order), "_ck_gidx",
                       num_partitions)
    sizes = idx.groupBy(*g).agg(F.count(F.lit(1)).alias(_CNT))
    w = Window.orderBy(*g).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*g, F.coalesce(F.sum(_CNT).over(w), F.lit(0)).alias(_OFF))
    return (idx.join(F.broadcast(starts), g)
               .withColumn(name, (F.col("_ck_gidx") - F.col(_OFF)).cast("long"))
               .drop("_ck_gidx", _OFF))


def running_sums(df: DataFrame, index_col: str, value_cols: Sequence[str],
                 suffix: str = "_cum", chunk: int = 4096) -> DataFrame:
    """Inclusive prefix sums along a dense integer ``index_col``.

    Rows are grouped into chunks of ``chunk`` consecutive indexes; each chunk is a
    window partition.  The chunk totals, one row per chunk, are summed the same
    way, level by level, until one chunk holds them all; so no task sums more
    than ``chunk`` rows and nothing is broadcast that grows with the data.
    """
    top = df.agg(F.max(index_col)).first()[0]
    return _running(df, index_col, list(value_cols), suffix, chunk, 0 if top is None else int(top), 0)


def _running(df: DataFrame, index_col: str, value_cols: list[str], suffix: str, chunk: int, top: int, level: int) -> DataFrame:
    part, of, off = f"_ck_chunk{level}", f"_ck_of{level}", f"_ck_off{level}_"
    base = df.withColumn(part, F.floor(F.col(index_col) / F.lit(chunk)))
    wl = (Window.partitionBy(part).orderBy(index_col)
                .rowsBetween(Window.unboundedPreceding, 0))
    local = base.select("*", *[F.sum(c).over(wl).alias(f"{c}{suffix}") for c in value_cols])
    if top < chunk:  # one chunk holds every index
        return local.drop(part)
    totals = base.groupBy(F.col(part).alias(of)).agg(*[F.sum(c).alias(c) for c in value_cols])
    before = _running(totals, of, value_cols, "_ck_sum", chunk, top // chunk, level + 1)
    before = before.select(of, *[(F.col(f"{c}_ck_sum") - F.col(c)).alias(off + c) for c in value_cols])
    out = local.join(before, F.col(part) == F.col(of))
    for c in value_cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"{c}{suffix}") + F.col(off + c))
    return out.drop(part, of, *[off + c for c in value_cols])


def trailing_sums(df: DataFrame, index_col: str, value_cols: Sequence[str],
                  width: int, suffix: str = "_win") -> DataFrame:
    """Sum over the ``width`` trailing indexes (i-width+1 .. i) of a dense
    integer index, as a shuffle aggregation: every row contributes to the
    ``width`` targets it belongs to.  No window, no ordering task.
    """
    contrib = df.select(
        F.explode(F.sequence(F.col(index_col), F.col(index_col) + F.lit(width - 1))).alias("_ck_t"),
        *value_cols)
    sums = contrib.groupBy("_ck_t").agg(*[F.sum(c).alias(f"{c}{suffix}") for c in value_cols])
    return df.join(sums.withColumnRenamed("_ck_t", index_col), index_col, "left")
