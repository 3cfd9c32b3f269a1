"""A layout for looking customers up (G3, G4): buckets sorted by id, and a posting list of the digits in ids."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.session import scratch_path

GRAM = 3


def write_lookup(df: DataFrame, key: str, buckets: int = 64, path: str | None = None, name: str | None = None) -> str:
    """Save ``df`` as a table in hash buckets of ``key``, sorted by it, with Parquet bloom filters on it; the table's name.

    An equality on the key reads one bucket's files, and in them only row groups
    whose range and bloom filter may hold it.  Rows are dealt by bucket before the
    write, so there is one file per bucket.
    """
    spark = df.sparkSession
    name = name or f"lookup_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, F.col(key)).write.bucketBy(buckets, key).sortBy(key)
     .option("path", path or scratch_path(spark, name)).option(f"parquet.bloom.filter.enabled#{key}", "true")
     .mode("errorifexists").saveAsTable(name))
    return name


def lookup(spark: SparkSession, name: str, key: str, value: int) -> DataFrame:
    """The rows of one id."""
    return spark.table(name).where(F.col(key) == F.lit(int(value)))


def digit_grams(ids: DataFrame, key: str) -> DataFrame:
    """(grama, key): every run of one to three characters of an id's text, once per id."""
    text = F.col(key).cast("string")

    def runs(n: int):
        at = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(at, lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    some = [runs(n) for n in range(1, GRAM + 1)]
    return ids.select(F.explode(F.array_distinct(F.concat(*some))).alias("grama"), F.col(key))


def write_postings(ids: DataFrame, key: str, buckets: int = 64, path: str | None = None, name: str | None = None) -> str:
    """Save the posting list of all ids, in hash buckets of the gram; the table's name.

    A one-digit gram is in most ids, so rows are dealt by gram and id (a gram's
    postings are in several files of its bucket, none of them whole).
    """
    spark = ids.sparkSession
    name = name or f"postings_{uuid.uuid4().hex[:12]}"
    grams = digit_grams(ids, key)
    (grams.repartition(buckets, "grama", F.pmod(F.xxhash64(key), F.lit(8))).write.bucketBy(buckets, "grama").sortBy("grama", key)
     .option("path", path or scratch_path(spark, name)).mode("errorifexists").saveAsTable(name))
    return name


def ids_containing(spark: SparkSession, postings: str, key: str, typed: str) -> DataFrame:
    """Ids whose text contains ``typed`` (trimmed): those with all of its grams, then checked.

    Text of up to three characters is a gram itself; of longer text every run of
    three must be there.  Only the buckets of these grams are read.  Empty text
    matches every id; text with other characters than digits and a sign matches none.
    """
    s = (typed or "").strip()
    table = spark.table(postings)
    if not s:
        return table.select(key).distinct()
    if not re.fullmatch(r"-?[0-9]+", s):
        return table.select(key).where(F.lit(False))
    grams = sorted({s[i:i + GRAM] for i in range(max(1, len(s) - GRAM + 1))})
    some = table.where(F.col("grama").isin(grams))
    if len(grams) == 1:
        return some.select(key).where(F.col(key).cast("string").contains(s))
    full = some.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return full.select(key).where(F.col(key).cast("string").contains(s))
