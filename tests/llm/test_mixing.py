import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from churnkit.llm import mixing as M
from llm_text import frame, prose  # noqa: F401


def slow_targets(sizes):
    """Sizes by source -> targets, by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        give = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s, x in give.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def words(t):
    return len((t or "").encode().split())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    sources = ["hot"] * 12 + ["a", "B", "é", "zz", "", None]
    out = [(i, prose(rng, rng.randint(0, 40)), rng.choice(sources)) for i in range(700)]
    return [*out, (5000, None, "hot"), (None, "one two", "a"), (None, "one two", "a"), (5001, "x " * 900, "zz"), out[0], out[0], (5002, "", "nothing")]


def check(rows, got):
    sizes, text = defaultdict(int), {}
    for _, t, s in rows:
        sizes[s] += words(t)
    target = slow_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, words(t), s) for i, t, s in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and np.isclose(r.target, target[r.source], rtol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6


def test_targets_and_taken(frame, rows, monkeypatch):
    check(rows, M.mix(frame(rows)).collect())
    monkeypatch.setattr(M, "LEAF", 8)
    monkeypatch.setattr(M, "FAN", 3)
    check(rows, M.mix(frame(rows)).collect())


def test_reruns_agree(frame, rows):
    a, b = (sorted(map(str, M.mix(frame(rows, parts)).select("doc_id", "source", "text_hash", "again", "copies").collect())) for parts in (1, 5))
    assert a == b
    assert a != sorted(map(str, M.mix(frame(rows), seed=99).select("doc_id", "source", "text_hash", "again", "copies").collect()))


def test_pivot_keeps_the_sum_and_the_means():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 50, 30).astype(float), rng.random(30)
    total = np.zeros(30)
    for _ in range(4000):
        out, left = M.pivot(p, size, rng)
        assert np.isclose((out * size).sum(), (p * size).sum())
        assert all(x in (0.0, 1.0) for k, x in enumerate(out) if k != left)
        if left >= 0:
            assert 0 < out[left] < 1
            out[left] = rng.random() < out[left]
        total += out
    assert np.abs(total / 4000 - p).max() < 0.05


def test_rows_of_the_mix(frame, rows):
    df = frame(rows)
    plan = M.mix(df).collect()
    got = M.mixed_rows(df)
    assert got.columns == df.columns
    want = Counter()
    for r in plan:
        want[r.doc_id, r.source, r.size] += r.copies
    have = Counter((r.doc_id, r.source, words(r.text)) for r in got.collect())
    assert have == Counter({k: n for k, n in want.items() if n})


def test_empty(frame):
    df = frame([(1, "x", "s")]).where("doc_id < 0")
    assert M.mix(df).collect() == [] and M.mixed_rows(df).collect() == []
    got = M.mix(frame([(1, "", "s"), (2, None, None)])).collect()
    assert [r.taken for r in got] == [0, 0] and [r.target for r in got] == [0.0, 0.0]
