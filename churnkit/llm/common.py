"""Small helpers shared by the operators: tables in the shared folder, words, Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.session import scratch_path

#: words are maximal runs of bytes that are not one of these (regex and bytes.split agree on them)
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut lineage that any executor can reread."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str) -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column of an Arrow batch as Python bytes (null: empty)."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                                       for c, f in zip(columns, schema)], schema=schema)


def whole(batches: Iterator[pa.RecordBatch], schema_names: list[str]) -> dict[str, np.ndarray]:
    """All rows of one partition as numpy columns (partitions are sized by the shuffle)."""
    parts: dict[str, list] = {n: [] for n in schema_names}
    for b in batches:
        for n in schema_names:
            parts[n].append(b.column(n).to_numpy(zero_copy_only=False))
    return {n: np.concatenate(p) if p else np.empty(0, dtype=np.int64) for n, p in parts.items()}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches a few rows at a time, so that Python copies of texts stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, altered where ``df`` has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
