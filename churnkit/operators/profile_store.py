"""A mergeable profile (P4, P7, P9, P13): sketches per input file, kept and merged; only new files are read.

Per file and column the store holds row and null counts, a HyperLogLog sketch of
distinct values, a KLL sketch of numbers and the counts of frequent values.  All
of them merge in any order, so the profile of a table to which files are added
is the merge of what is stored and of the new files' sketches.

Errors: distinct counts have a relative standard error of 0.8 % (2^14 registers)
and are exact while a column has few values; a quantile's rank is off by about
0.1 % (k = 4,096; exact below 4,096 values); a file's frequent values are exact
up to ``MAX_VALUES`` distinct ones, beyond which each count may miss up to
the store's ``erro`` for the column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HLL_BITS, KLL_K = 14, 4096
MAX_VALUES = 1024
SKETCHES = "arquivo string, coluna string, linhas long, nulos long, hll binary, kll binary"
VALUES = "arquivo string, coluna string, valor string, n long, erro long"


def _columns(df: DataFrame) -> tuple[list[str], list[str]]:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return text, [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def sketch_files(df: DataFrame, file: F.Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(sketches, values) of every input file of ``df``, one row per file and column, and per frequent text value.

    ``file`` names a row's file (its path by default).  One aggregation by
    file; partial sketches are merged, so a file may be read by several tasks.
    """
    text, numbers = _columns(df)
    named = df.withColumn("_ck_file", F.input_file_name() if file is None else file)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate([*text, *numbers]):
        col = F.col(f"`{c}`")
        aggs.append(F.count_if(col.isNull()).alias(f"z{i}"))
        key = F.coalesce(col, F.lit("")) if c in text else F.coalesce(col.cast("double"), F.lit(0.0)).cast("string")
        aggs.append(F.hll_sketch_agg(F.when(col.isNotNull(), key), F.lit(HLL_BITS)).alias(f"h{i}"))
        if c in numbers:
            aggs.append(F.kll_sketch_agg_double(col.cast("double"), F.lit(KLL_K)).alias(f"k{i}"))
    rows = named.groupBy("_ck_file").agg(*aggs)
    each = [F.struct(F.lit(c).alias("coluna"), F.col("n").alias("linhas"), F.col(f"z{i}").alias("nulos"), F.col(f"h{i}").alias("hll"),
                     (F.col(f"k{i}") if c in numbers else F.lit(None).cast("binary")).alias("kll")) for i, c in enumerate([*text, *numbers])]
    sketches = rows.select(F.col("_ck_file").alias("arquivo"), F.explode(F.array(*each)).alias("s")).select("arquivo", "s.*")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(f"`{c}`").alias("valor")) for c in text])).alias("p")
    counts = named.select("_ck_file", pairs).groupBy(F.col("_ck_file").alias("arquivo"), "p.coluna", "p.valor").agg(F.count(F.lit(1)).alias("n"))
    return sketches, _frequent(counts.withColumn("erro", F.lit(0).cast("long")), ["arquivo", "coluna"])


def _frequent(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ``MAX_VALUES`` largest counts of each group; ``erro`` is the largest count that was left out.

    Spark keeps the first rows of each group in the tasks already (a rank filter),
    so no task sorts all values of a column of very many.
    """
    down = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc_nulls_first("valor"))
    top = counts.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= MAX_VALUES + 1)
    left_out = F.coalesce(F.max(F.when(F.col("_r") == MAX_VALUES + 1, F.col("n"))).over(Window.partitionBy(*by)), F.lit(0))
    return top.withColumn("_out", left_out).where(F.col("_r") <= MAX_VALUES).select(*by, "valor", "n", (F.col("erro") + F.col("_out")).cast("long").alias("erro"))


class ProfileStore:
    """Sketches of the files seen so far, under ``base``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.base}/{name}"
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def files(self) -> set[str]:
        """Files that are in the store (their sketches are written last, so a file is in it whole)."""
        return {r[0] for r in self._read("sketches", SKETCHES).select("arquivo").distinct().collect()}

    def add(self, paths: Sequence[str]) -> list[str]:
        """Read the files of ``paths`` that the store lacks; their names.  What a failed run left is written again under its file's name."""
        known = self.files()
        new = sorted(f for f in self.spark.read.parquet(*paths).inputFiles() if f not in known)
        if new:
            sketches, values = sketch_files(self.spark.read.parquet(*new))
            values.write.mode("append").parquet(f"{self.base}/values")
            sketches.write.mode("append").parquet(f"{self.base}/sketches")
        return new

    def columns(self) -> DataFrame:
        """(coluna, linhas, nulos, distintos, q25, q50, q75) of all files together; quartiles of numbers only."""
        merged = self._read("sketches", SKETCHES).dropDuplicates(["arquivo", "coluna"]).groupBy("coluna").agg(
            F.sum("linhas").alias("linhas"), F.sum("nulos").alias("nulos"), F.hll_union_agg("hll").alias("hll"),
            F.kll_merge_agg_double("kll", F.lit(KLL_K)).alias("kll"))
        some = F.col("kll").isNotNull() & (F.kll_sketch_get_n_double("kll") > 0)
        quart = [F.when(some, F.kll_sketch_get_quantile_double("kll", F.lit(q))).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
        return merged.select("coluna", "linhas", "nulos", F.hll_sketch_estimate("hll").alias("distintos"), *quart)

    def top_values(self, column: str, k: int = 15) -> DataFrame:
        """The ``k`` most frequent values of a text column (nulls too) and by how much a count may be too low."""
        rows = self._read("values", VALUES).where(F.col("coluna") == column).dropDuplicates(["arquivo", "valor"])
        erro = rows.groupBy("arquivo").agg(F.max("erro").alias("e")).agg(F.coalesce(F.sum("e"), F.lit(0)).alias("erro"))  # one row
        return (rows.groupBy("valor").agg(F.sum("n").alias("contagem")).orderBy(F.desc("contagem"), F.asc_nulls_first("valor")).limit(k)
                .join(F.broadcast(erro)).select("valor", "contagem", "erro"))
