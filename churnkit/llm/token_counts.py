"""Token counts with a digest cache: only contents the cache doesn't know are encoded, each once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import batch, materialise, partitions, slices, text_of
from churnkit.llm.tokens import encoder, tokenizer_path, tokenizer_version

CACHE_SCHEMA = "version string, digest string, n_tokens long"


def normalised(text: F.Column) -> F.Column:
    """White-space runs become one space and the ends are trimmed: the word tokenizer drops white space, so its counts stay."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, digest.

    Contents are named by the SHA-256 of their (for the word tokenizer
    normalised) text and joined to the cache's rows of this tokenizer version.
    Each distinct digest that is missing is encoded once, whole, and appended to
    the cache (Parquet in a shared folder; an append that is repeated after a
    failure does no harm, since rows of one digest agree).  Null text counts as
    empty, with 0 tokens; repeated rows come out repeatedly; an empty table gives
    an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    version = tokenizer_version(path)
    text = text_of(text_col)
    content = normalised(text) if path == tokenizer_path() else text
    named = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"),
                        F.sha2(content, 256).alias("digest"), text.alias("text"))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(cache_path)

    def stored() -> DataFrame:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)
        return cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    known = materialise(stored(), "known")
    missing = named.select("digest", "text").join(known, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    out = pa.schema([("digest", pa.string()), ("n_tokens", pa.int64())])

    def encode(batches):
        enc = encoder(path)
        for part in slices(batches):
            ids = enc.encode(part.column("text").to_pylist())
            yield batch(out, part.column("digest").cast(pa.string()), [len(x) // 4 for x in ids])

    (missing.repartition(partitions(spark), "digest").mapInArrow(encode, "digest string, n_tokens long")
     .select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path))
    counts = materialise(stored(), "counts")
    return named.drop("text").join(counts, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
