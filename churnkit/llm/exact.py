"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import fresh, materialise, text_of

PREFIX = 64
#: a table of (length, prefix hash) classes is broadcast up to so many rows of 16 bytes; beyond that it is joined by a shuffle
BROADCAST_ROWS = 250_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX,
                digest: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, text_hash.

    Texts are equal when they are the same string; null counts as empty.
    Lengths that occur once drop out first, then (length, hash of the first
    ``prefix`` characters) classes that occur once; the whole text is hashed
    (SHA-256) only for rows left then, and equal (length, SHA-256) make a group.
    With ``digest`` the other rows' SHA-256 is added for output, else it is null.
    Of a group the row with the largest id stays (null ids below all others);
    rows that repeat id and text are copies too, one of them stays.  An empty
    table gives an empty result; other columns are not read.
    """
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("len"),
                       F.xxhash64(F.substring(text, 1, prefix)).alias("ph"))
    lens = materialise(base.groupBy("len").count().where("count > 1").select("len"), "lengths")
    classes = materialise(base.select("len", "ph").join(lens, "len", "left_semi")
                          .groupBy("len", "ph").count().where("count > 1").select("len", "ph", F.lit(True).alias("hit")), "prefixes")
    small = F.broadcast(classes) if classes.count() <= BROADCAST_ROWS else classes
    hit = F.col("hit").isNotNull()
    full = F.sha2("text", 256)
    rows = base.join(small, ["len", "ph"], "left").select(
        "id", "len", hit.alias("hit"), (full if digest else F.when(hit, full)).alias("sha"),
        F.xxhash64("text").alias("text_hash"))
    # a row's number in the written table tells rows apart that repeat id and text
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "hashed")
    each = materialise(rows.where("hit").groupBy("len", "sha", "id").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "ids")
    groups = each.groupBy("len", "sha").agg(F.max("id").alias("keep"), F.sum("n").alias("n")).where("n > 1")
    of = each.select(F.col("len").alias("l"), F.col("sha").alias("s"), F.col("id").alias("i"), "first")
    same = (F.col("len") == F.col("l")) & (F.col("sha") == F.col("s")) & F.col("keep").eqNullSafe(F.col("i"))
    groups = materialise(groups.join(of, same).select("len", "sha", "keep", "n", "first"), "groups")
    single = F.col("n").isNull()
    return rows.join(groups, ["len", "sha"], "left").select(
        F.col("id").alias(id_col), F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("row") == F.col("first"))).alias("kept"),
        F.col("sha").alias("text_sha256"), "text_hash")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one row of each group of equal texts."""
    gid, ghash, stays = fresh(docs, "gone_id", "gone_hash", "stays")
    found = exact_dedup(docs, id_col, text_col)
    gone = materialise(found.where("not kept").groupBy(F.col(id_col).alias(gid), F.col("text_hash").alias(ghash))
                       .agg(F.max(F.col(id_col).eqNullSafe(F.col("keep_id"))).alias(stays)), "gone")
    key = F.col(id_col).eqNullSafe(F.col(gid)) & (F.xxhash64(text_of(text_col)) == F.col(ghash))
    out = docs.join(gone.where(~F.col(stays)), key, "left_anti")
    repeated = gone.where(stays)  # the row that stays itself occurs several times: one of them is enough
    if repeated.isEmpty():
        return out
    many = out.join(repeated, key, "left_semi").dropDuplicates([id_col, text_col])
    return out.join(repeated, key, "left_anti").unionByName(many)
