import random

import numpy as np

from churnkit.llm.token_counts import CACHE_SCHEMA, count_tokens
from churnkit.llm.tokens import Encoder, tokenizer_path
from llm_text import edge_rows, frame  # noqa: F401


def library(rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    return sorted((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)


ODD = [(900, "it's THEİ ΣΣ é é"), (901, "<|endoftext|>x<|endoftext|>"), (902, "a b c\x1cd \x85e"),
       (903, "123 4567's !!??'ll"), (904, "́ x ́"), (905, "A" * 5000), (906, "<|ENDOFTEXT|>")]


def test_counts_and_cache(spark, frame, edge_rows, tmp_path):
    rows = [*edge_rows, *[(i, t, "s") for i, t in ODD]]
    cache = str(tmp_path / "cache")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(frame(rows), cache).collect())
    assert got == library(rows)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    n = stored.count()
    assert n == stored.select("digest").distinct().count()
    more = [*rows, (999, "something quite new", "s")]
    got = count_tokens(frame(more), cache, limit=3).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == library(more)
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)
    assert spark.read.schema(CACHE_SCHEMA).parquet(cache).count() == n + 1


def test_stored_counts_are_used(spark, frame, tmp_path):
    cache = str(tmp_path / "cache")
    count_tokens(frame([(1, "a b")]), cache).collect()
    spark.read.schema(CACHE_SCHEMA).parquet(cache).selectExpr("version", "digest", "n_tokens + 100 as n_tokens").write.parquet(cache + "2")
    assert count_tokens(frame([(5, "a  b ")]), cache + "2").first().n_tokens == 102


def test_words_of_the_encoder_are_the_librarys():
    enc = Encoder(tokenizer_path())
    rng = random.Random(4)
    words = ["".join(rng.choices("abETHÀÖØöÿßñéÇthe", k=rng.randint(1, 9))) + rng.choice(["", ",", "!!", "%%%", "'s", "...", "`{~"]) for _ in range(3000)]
    texts = [t for _, t in ODD] + ["", " ", "plain words here\nand there", " ".join(words), "x" * 200 + " " + "é" * 90 + " y"]
    want = [np.array(x, "<u4").tobytes() for x in enc.many(texts)]
    assert enc.encode(texts) == want
    enc.CACHE = 50  # a cache that is emptied all the time
    assert [enc.encode([t])[0] for t in texts + texts] == want + want


def test_other_tokenizers(frame, tmp_path):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    rows = [(1, "Some  text with\n\nspace "), (2, None), (3, "é 中文")]
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(rows), str(tmp_path / "c"), path).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in rows}
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(rows), str(tmp_path / "c"), path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_empty(frame, tmp_path):
    assert count_tokens(frame([(1, "x")]).where("doc_id < 0"), str(tmp_path / "c")).collect() == []
