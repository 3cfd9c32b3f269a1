"""Documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnkit.llm.common import documents, materialise
from churnkit.llm.exact import drop_duplicates
from churnkit.llm.mixing import mixed_rows
from churnkit.llm.packing import pack
from churnkit.llm.simhash import keep_one
from churnkit.llm.weak_quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier keeps, all columns with their values.

    Null and empty texts go as blank; null ids and repeated rows are judged by
    their text; an empty table stays empty, here and in all stages."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id, null ids last; null counts as empty text."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints: the smallest id.

    Texts without words have fingerprint zero and are one group."""
    return keep_one(docs, shingle=4, max_bits=4)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; a null source is a source, rows that repeat are taken one by one."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of at most 2048 tokens; empty and null texts are their end id alone."""
    return pack(docs, capacity=2048)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near),
          ("mixing", mixing), ("packing", packing)]

#: SQL can't express the stages; tests/llm holds them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
