import hashlib
import random

import numpy as np
import pytest

from churnkit.llm import suffix_dedup as S
from llm_text import frame  # noqa: F401


def slow(docs, length):
    seen, out = set(), {}
    for i, text in docs:
        raw = text.encode()
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            if w in seen:
                cover[p:p + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out[i] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(length, seed=5):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcd éz", k=rng.randint(length, 4 * length))) for _ in range(5)]
    docs = []
    for i in range(60):
        parts = [rng.choice(["".join(rng.choices("abcdefgh éz", k=rng.randint(0, 2 * length))), rng.choice(passages), rng.choice(passages)[3:-2],
                             "ab" * rng.randint(1, length)]) for _ in range(rng.randint(0, 6))]
        docs.append((3 * i, "".join(parts)))
    return docs + [(1000 + i, docs[7][1]) for i in range(8)] + [(5000, None)]


def compare(frame, docs, length):
    want = slow(sorted((i, t or "") for i, t in docs), length)
    got = S.dedup_passages(frame(docs), length).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(r.n_removed for r in got) > 0


def test_cover_takes_any_two_residues():
    member, shift = S.cover_tables()
    assert member.sum() == 6 and (shift >= 0).all()
    i, j = np.indices(shift.shape)
    assert member[(i + shift) % S.COVER].all() and member[(j + shift) % S.COVER].all()


def test_suffixes_are_sorted():
    rng = random.Random(3)
    for _ in range(60):
        texts = [bytes(rng.choices(b"ab\0", k=rng.randint(1, 60))) * rng.randint(1, 3) for _ in range(rng.randint(1, 8))]
        buf = np.frombuffer(b"".join(x + b"\0" * 8 for x in texts), dtype=np.uint8)
        sizes = np.array([len(x) + 8 for x in texts])
        begin = np.cumsum(sizes) - sizes
        end = np.repeat(begin + sizes - 8, sizes)
        at = np.concatenate([np.arange(b, b + len(x)) for b, x in zip(begin, texts)])
        key = [bytes(buf[p:end[p]]).ljust(400, b"\0") for p in at]
        assert [key[i] for i in S.sort_suffixes(buf, end, at)] == sorted(key)


def test_blocks_cover_all_windows_and_hash_content():
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"abc", k=rng.randint(0, 300))) for _ in range(20)] + [b"xyz" * 80]
    piece, start, windows, dist, g, h = S.blocks(texts, 30, 7)
    seen = {}
    for p, s, n, d, gg, hh in zip(piece, start, windows, dist, g, h):
        for k in range(n):
            seen[p, s + k] = seen.get((p, s + k), 0) + 1
            assert 0 <= d - k <= 30 - 7
            window = texts[p][s + k:s + k + 30]
            assert seen.setdefault(("minimizer", window), gg) == gg
        text = texts[p][s:s + n - 1 + 30]
        assert seen.setdefault(("hash", gg, hh), text) == text
    assert all(seen[p, s] == 1 for p, t in enumerate(texts) for s in range(len(t) - 29))


@pytest.mark.parametrize("length", [3, 40])
def test_against_brute_force(frame, length):
    compare(frame, corpus(length), length)


def test_large_buckets_and_pieces(frame, monkeypatch):
    monkeypatch.setattr(S, "HOT_LEAST", 1)
    monkeypatch.setattr(S, "HOT_SHARE", 10**9)
    monkeypatch.setattr(S, "SAMPLE", 1)
    monkeypatch.setattr(S, "PIECE", 50)
    monkeypatch.setattr(S, "GROUP", 400)
    compare(frame, corpus(20), 20)


def test_null_ids_and_repeated_rows(frame):
    text = "one passage that is long enough to count " * 2
    rows = [(4, text), (4, text), (2, "x " + text), (None, text + "!"), (9, None)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in S.dedup_passages(frame(rows), 20).collect())
    first = len(slow([(2, "x " + text)], 20)) and slow([(2, "x " + text)], 20)[2][1]
    assert got == sorted([("2", len(text) + 2, first), ("4", len(text), len(text)), ("4", len(text), len(text)), ("9", 0, 0), ("None", len(text) + 1, len(text))])


def test_a_repeated_row_keeps_its_text(frame):
    rng = random.Random(11)
    once, null_id = ("".join(rng.choices("abcdefgh", k=300)) for _ in range(2))
    rows = [(4, once), (4, once), (4, once), (7, "y" + once), (None, null_id), (None, null_id), (9, None), (9, None)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in S.dedup_passages(frame(rows), 100).collect())
    assert got == [("4", 300, 0, 0)] * 3 + [("7", 301, 300, 1)] + [("9", 0, 0, 0)] * 2 + [("None", 300, 0, 0)] * 2


def test_kept_text(frame):
    rows = [(1, "abcdefghij" * 2), (2, "..abcdefghij..")]
    got = {r.doc_id: bytes(r.kept_text) for r in S.dedup_passages(frame(rows), 8, with_text=True).collect()}
    assert got == {1: b"abcdefghij", 2: b"...."}


def test_empty(frame):
    assert S.dedup_passages(frame([(1, "x")]).where("doc_id < 0")).collect() == []
