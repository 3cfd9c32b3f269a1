"""Readers for the driver's parquet tables (column pruning and filter
pushdown are left to the parquet scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


_HANDLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table handle, reused within one Spark application (the file
    listing and footer schema are read once)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    k = (spark.sparkContext.applicationId, path)
    if k not in _HANDLES:
        _HANDLES[k] = spark.read.parquet(path)
    return _HANDLES[k]
