"""Queries of the operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.llm.common import documents
from churnkit.session import scratch_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.simhash import simhash_dedup
    return simhash_dedup(documents(spark, sf_dir), shingle=4, max_bits=4).select("doc_id", "fingerprint", "component_id")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.suffix_dedup import dedup_passages
    return dedup_passages(documents(spark, sf_dir), min_length=100)


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.ppm import score_corpus
    return score_corpus(documents(spark, sf_dir))


def op4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.phrases import fingerprint_edits
    return fingerprint_edits(documents(spark, sf_dir))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.exact import exact_dedup
    return exact_dedup(documents(spark, sf_dir), digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.packing import pack
    return pack(documents(spark, sf_dir), capacity=2048)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.mixing import mix
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.token_counts import count_tokens
    cache = scratch_path(spark, "token-cache")
    return count_tokens(documents(spark, sf_dir), cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.licenses import scan
    files = documents(spark, sf_dir).select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    found = scan(files).withColumn("doc_id", F.element_at(F.split("path", "/"), -1).cast("long"))
    return found.select("doc_id", "path", "own_licence", "cosine", "licence_file", "licence", "inherited_from")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.weak_quality import classify
    return classify(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "weak_label", "quality_score", "quality_keep")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.ranked_search import search
    return search(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), top=50)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.byte_bpe import decode, encode
    texts = decode(encode(documents(spark, sf_dir)))
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.filter_audit import audit
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run
    return run(spark, sf_dir)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_passages": op2_passages,
    "op3_ppm": op3_ppm,
    "op4_phrases": op4_phrases,
    "op5_exact": op5_exact,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_licenses": op9_licenses,
    "op10_quality": op10_quality,
    "op11_ranked_search": op11_ranked_search,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}

LLM_ORACLE: dict[str, str] = {
    "op5_exact": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_ranked_search": """
        WITH bags AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
        size AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM bags),
        tf AS (SELECT doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM bags) GROUP BY ALL),
        wanted AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
        weights AS (
            SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), size),
        scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
            FROM wanted JOIN tf USING (t) JOIN weights USING (t), size GROUP BY item_id, doc_id),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
            FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
    "op13_filter_audit": """
        WITH words AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        facts AS (
            SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                   100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
                   regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM words),
        docs AS (
            SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask,
                   coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS tox
            FROM facts LEFT JOIN labels USING (doc_id)),
        cells AS (SELECT part, mask, good, tox, count(*) AS n FROM docs GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
        orders AS (
            SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
            FROM letters v, letters w, letters x, letters y, letters z
            WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31 AND v.bit | w.bit | x.bit | y.bit | z.bit = 31),
        steps AS (
            SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS ran
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
        counted AS (
            SELECT part, filter_order, step::INT AS step, bit,
                   sum(CASE WHEN mask & (ran | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN mask & ran = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN mask & ran <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN mask & ran = 0 AND mask & bit <> 0 THEN n * good ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN mask & ran = 0 AND mask & bit <> 0 THEN n * tox ELSE 0 END)::BIGINT AS toxic_lost
            FROM cells, steps GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted""",
}
