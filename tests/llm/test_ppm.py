import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from churnkit.llm import ppm as M
from llm_text import frame  # noqa: F401

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def slow_base(rows):
    tokens = [(t or "").translate(LOWER).encode().split() + [b" "] for _, t, *_ in rows]
    c = Counter(w for (i, *_), ts in zip(rows, tokens) if not held(i) for w in ts)
    n, v = sum(c.values()), len(c)
    den = math.log10(n + 0.5 * (v + 1))
    return n, [(len(t), sum(c[w] > 0 for w in t), sum(math.log10(c[w] + 0.5) - den for w in t)) for t in tokens]


def slow_scores(rows, order):
    trie = defaultdict(Counter)
    texts = [[257] * order + list((t or "").translate(LOWER).encode()) + [256] for _, t, *_ in rows]
    for (i, *_), s in zip(rows, texts):
        if not held(i):
            for p in range(order, len(s)):
                for k in range(order + 1):
                    trie[tuple(s[p - k:p])][s[p]] += 1
    out = []
    for s in texts:
        total = 0.0
        for p in range(order, len(s)):
            gone, found = set(), False
            for k in range(order, -1, -1):
                left = {a: n for a, n in trie.get(tuple(s[p - k:p]), {}).items() if a not in gone}
                if not left:
                    continue
                den = 2 * sum(left.values())
                if s[p] in left:
                    total += math.log10((2 * left[s[p]] - 1) / den)
                    found = True
                    break
                total += math.log10(len(left) / den)
                gone |= set(left)
            if not found:
                total -= math.log10(257 - len(gone))
        out.append(total)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    out = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))).title()) for i in range(80)]
    return [*out, (200, None), (201, ""), (None, "no id Here"), (None, "no id Here"), (3, out[3][1]), (202, "\x00\x01 Zebra \U0001f600"), (203, "w " * 700), (204, "ab" * 4000)]


def key(x):
    return str(x)


@pytest.mark.parametrize("order,shard", [(5, None), (2, None), (3, 3000), (0, None)])
def test_against_brute_force(frame, rows, order, shard, monkeypatch):
    if shard:
        monkeypatch.setattr(M, "SHARD_BYTES", shard)
    got = M.score_corpus(frame(rows), order=order).collect()
    n, base = slow_base(rows)
    want = sorted(((i, held(i), *b, s) for (i, *_), b, s in zip(rows, base, slow_scores(rows, order))), key=key)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    assert len(have) == len(want) and all(r.train_tokens == n for r in got)
    by = lambda x: (str(x[0]), x[2], round(x[4], 4))
    for a, b in zip(sorted(have, key=by), sorted(want, key=by)):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], abs_tol=1e-6) and math.isclose(a[5], b[5], rel_tol=1e-6, abs_tol=1e-5)


def test_small_chunks_change_nothing(frame, rows, monkeypatch):
    want = sorted(map(lambda r: (str(r.doc_id), r.n_known, round(r.score, 2)), M.score_corpus(frame(rows)).collect()))
    for name, value in (("CHUNK", 200), ("WORD_CHUNK", 300), ("KEEP", 50)):
        monkeypatch.setattr(M, name, value)
    assert sorted(map(lambda r: (str(r.doc_id), r.n_known, round(r.score, 2)), M.score_corpus(frame(rows, 5)).collect())) == want


def test_probabilities_sum_to_one(frame, spark, rows):
    texts = frame([r for r in rows if r[1]]).select("text")
    entries, contexts = M.train(texts, 3)
    trie = M.Trie(M.collect_shard(entries, contexts, 3, 0, 1), 3, 0, 1)
    for ctx in ([257, 257, 257], [97, 98, 32], [1, 2, 3], [32, 97, 98], [257, 257, 110], [122, 101, 98]):
        base = ctx[0] << 27 | ctx[1] << 18 | ctx[2] << 9
        p = 10 ** trie.log10(np.array([base | s for s in range(257)], dtype=np.uint64))
        assert math.isclose(p.sum(), 1, rel_tol=1e-4)


def test_steps_and_times_are_packed():
    own, word, times = np.array([0, 0, 1, 2, 2]), np.array([3, 200_000, 70_000, 0, 65_535]), np.array([1, 600, 255, 256, 2])
    steps, n, first = M._packed(own, word, times, 3)
    for d in range(3):
        walk = np.cumsum(steps[first[d]:first[d + 1]].astype(np.int64))
        got = Counter()
        for w, t in zip(walk.tolist(), n[first[d]:first[d + 1]].tolist()):
            got[w] += t
        assert {w: t for w, t in got.items() if t} == dict(zip(word[own == d].tolist(), times[own == d].tolist()))


def test_empty(frame):
    assert M.score_corpus(frame([(1, "x")]).where("doc_id < 0")).collect() == []
