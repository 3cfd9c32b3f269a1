import hashlib
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from churnkit.llm import byte_bpe as B
from churnkit.llm.tokens import tokenizer_path
from llm_text import edge_rows, frame, prose  # noqa: F401

PATH = tokenizer_path(B.BYTE_BPE)
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
OURS = B.PairIndexBpe(PATH)

ODD = ["", " ", "  ", "   x", "x   ", "a\n\n b\t\tc", "it's we'll I'M they're 'tis ''s", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext|",
       "é ñ ü ß 中文 ça 😀👩‍👩‍👧", "1234567 ½²③ ٣٤", "aaaa" * 50, "a" * 3001, "   x　y", "x\x1cy \x85z \x0b\x0c", "\x00\x01 \x7f",
       "=====----====", "é ́", "    def f(x):\n        return x\n"]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def unpacked(x):
    return np.frombuffer(x, "<u4").tolist()


def test_ids_are_the_librarys():
    rng = random.Random(8)
    texts = ODD + [prose(rng, 300) for _ in range(20)] + ["".join(rng.choices("aeinst h.\n'sé中 19", k=400)) for _ in range(200)]
    assert [unpacked(x) for x in OURS.encode(texts)] == [library(t) for t in texts]


def test_every_code_point():
    """All code points, each between letters, digits and signs, are cut and merged as the library does."""
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c}1{c}!{c} {c}" for c in points[at:at + 4096])
        assert unpacked(OURS.encode([text])[0]) == library(text), hex(ord(points[at]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from("ab 's\n'llt12")), max_size=80), max_size=4))
def test_random_texts(texts):
    got = OURS.encode(texts)
    assert [unpacked(x) for x in got] == [library(t) for t in texts]
    assert [OURS.decode(x) for x in got] == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50400), max_size=40))
def test_random_ids_decode_as_the_library_does(ids):
    assert OURS.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_small_caches_and_indexes(monkeypatch):
    rng = random.Random(2)
    texts = ODD + [prose(rng, 60) for _ in range(60)]
    small = B.PairIndexBpe(PATH)
    small.CACHE, small.KEPT, small.TEXTS, small.INDEXED = 40, 5, 200, 64
    assert small.encode(texts + texts) == OURS.encode(texts + texts)
    assert len(small.cache) <= 40


def slow_bpe(piece):
    """Merge the lowest rank, leftmost first, until none is left."""
    sym = [int(OURS.byte_id[b]) for b in piece]
    while True:
        pairs = [(OURS.ranks.get(a * OURS.width + b), k) for k, (a, b) in enumerate(zip(sym, sym[1:]))]
        pairs = [p for p in pairs if p[0] is not None]
        if not pairs:
            return sym
        r, k = min(pairs)
        sym[k:k + 2] = [OURS.made[r][2]]


def test_one_index_for_many_pieces():
    rng = random.Random(12)
    pieces = [bytes(rng.choices(b"abcdehinst \xc3\xa9", k=rng.randint(1, 40))) for _ in range(400)] + [b"a" * k for k in range(1, 30)]
    assert [unpacked(x) for x in OURS.merge(pieces)] == [slow_bpe(p) for p in pieces]


def test_table(spark, frame, edge_rows):
    rows = [*edge_rows, (None, "no id", "s"), *[(900 + k, t, "s") for k, t in enumerate(ODD)]]
    df = B.decode(B.encode(frame(rows)))
    got = df.collect()
    assert df.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    want = sorted((str(i), t or "", str(library(t or ""))) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.decoded, str(unpacked(r.ids))) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert B.decode(B.encode(frame([(1, "x")]).where("doc_id < 0"))).collect() == []


def test_query(spark):
    from churnkit.llm.queries import LLM_QUERIES
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in LLM_QUERIES["op12_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        B.PairIndexBpe(tokenizer_path())
