"""A table in hash buckets with copy-on-write upserts: only buckets with changed keys are rewritten.

The commit log of ``publish`` names the folder that holds each bucket now.  An
upsert reads and rewrites the touched buckets into a new folder and commits them
with one manifest file, so readers see all of it or none, and the other
buckets' files are not read at all.  A batch that is delivered again is skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.sources.publish import commit, commits

BUCKET = "balde"


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class BucketTable:
    """Rows with a unique ``key`` under ``base``; ``schema`` is a DDL string."""

    def __init__(self, spark: SparkSession, base: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.base, self.schema, self.key, self.buckets = spark, base.rstrip("/"), schema, key, buckets

    def places(self) -> dict[int, str]:
        """Bucket -> the folder that holds its rows now (one entry per bucket)."""
        last = commits(self.spark, self.base).groupBy("membro").agg(F.max_by("caminho", F.struct("versao", "tentativa")).alias("caminho"))
        return {int(r["membro"]): r["caminho"] for r in last.where("membro >= 0").collect()}

    def versions(self) -> int:
        return commits(self.spark, self.base).agg(F.max("versao")).first()[0] or 0

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        places = self.places()
        paths = [p for b, p in sorted(places.items()) if p and (only is None or b in only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, touched: list[int], batch: str | None) -> None:
        attempt, version = uuid.uuid4().hex, self.versions() + 1
        path = f"{self.base}/data/{attempt}"
        named = rows.withColumn(BUCKET, bucket_of(self.key, self.buckets))
        named.repartition(max(1, min(self.buckets, len(touched))), BUCKET).write.partitionBy(BUCKET).parquet(path)
        filled = {r[BUCKET]: r["n"] for r in self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(path)
                  .groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per bucket
        rows_ = [(version, attempt, str(b), f"{path}/{BUCKET}={b}" if b in filled else None, filled.get(b, 0)) for b in touched]
        if not rows_:  # a batch that changes nothing is still on record
            rows_ = [(version, attempt, "-1", None, 0)]
        commit(self.spark, self.base, [(*r, None, len(rows_), None, True, batch) for r in rows_])

    def create(self, rows: DataFrame) -> None:
        if self.versions():
            raise ValueError(f"{self.base} holds a table already")
        self._write(rows, list(range(self.buckets)), None)

    def upsert(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: str | None = None) -> list[int]:
        """Merge ``changes`` (with the key) into the table; the buckets that were rewritten.

        ``merge(old, changes)`` gets the rows of the touched buckets and returns
        their new rows.  A ``batch`` name that was committed before is skipped.
        """
        if batch is not None and not commits(self.spark, self.base).where(F.col("lote") == batch).isEmpty():
            return []
        touched = sorted(r[0] for r in changes.select(bucket_of(self.key, self.buckets).alias("b")).distinct().collect())  # buckets at most
        self._write(merge(self.read(touched), changes) if touched else self.spark.createDataFrame([], self.schema), touched, batch)
        return touched
