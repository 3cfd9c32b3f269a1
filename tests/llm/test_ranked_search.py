import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from churnkit.llm import ranked_search as R
from llm_text import edge_rows, frame, prose  # noqa: F401


def slow_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def slow(docs, items, top=50):
    bags = [(i, Counter(slow_terms(t))) for i, t in docs]
    N = sum(1 for _, b in bags if b)
    L = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    queries = {}
    for k, t in items:
        queries.setdefault(k, set()).update(slow_terms(t))
    out = []
    for k, terms in queries.items():
        scored = []
        for i, b in bags:
            n = sum(b.values())
            m = 100 - 50 + (50 * n * N) // L if L else 0
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if b[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out += [(k, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def items_of(rng, rows):
    """Items that share passages with documents and with each other, and odd ones."""
    texts = [t for _, t, *_ in rows if t]
    out = [(k, " ".join(rng.choice(texts).split()[:12]) + " " + prose(rng, 8)) for k in range(30)]
    out += [(k, out[rng.randrange(30)][1] + " " + out[rng.randrange(30)][1].upper()) for k in range(30, 45)]
    return out + [(50, None), (51, ""), (52, "zzzz-unseen"), (53, "É ñ"), (54, "word WORD"), (55, "a"), (55, "b c"), (None, "abc de fgh")]


@pytest.fixture(scope="module")
def case(edge_rows):
    rng = random.Random(21)
    rows = [*edge_rows, (None, edge_rows[5][1], "s"), (None, "no id", "s"), *[(2000 + k, prose(rng, 40), "s") for k in range(150)],
            *[(3000 - k, "one and the same text abc de", "s") for k in range(90)]]
    return rows, items_of(rng, rows)


def test_against_brute_force(spark, frame, case):
    rows, items = case
    df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as id", "2 as rank", "3 as item", "'x' as terms")
    want = slow([r[:2] for r in rows], items)
    assert found(R.search(spark, frame(rows), df)) == want
    assert found(R.search(spark, frame(rows, 1), df)) == want
    assert found(R.search(spark, frame(rows, 7), df, top=3)) == slow([r[:2] for r in rows], items, 3)


def test_blocks_of_items_and_small_batches(spark, frame, case, monkeypatch):
    rows, items = case
    monkeypatch.setattr(R, "BLOCK_ITEMS", 20)
    monkeypatch.setattr(R, "CELLS", 2000)
    monkeypatch.setattr(R, "RUN", 3)
    df = spark.createDataFrame(items, "item_id long, text string")
    assert found(R.search(spark, frame(rows), df)) == slow([r[:2] for r in rows], items)


def test_shared_sets_are_computed_once():
    rng = random.Random(1)
    base = [rng.sample(range(200), 30) for _ in range(4)]
    items = [sorted({*rng.choice(base), *rng.choice(base)[:15], *rng.sample(range(200), 5)}) for _ in range(60)] + [[], [7], [7], list(range(200))]
    s = R.mine(items, 200)
    below = {k: {t for t in range(200) if s.leaf[t] == k} for k in range(int(s.leaf.max()) + 1)}
    for level in s.levels:
        for n, a, b in level.tolist():
            assert not below[a] & below[b]
            below[n] = below[a] | below[b]
    for have, nodes in zip(items, s.item_nodes):
        parts = [below[n] for n in nodes]
        assert sum(map(len, parts)) == len(have) and set().union(*parts) == set(have)  # each term exactly once
    assert s.adds < s.plain_adds / 2
    values, term, doc = rng.choices(range(1, 10 ** 10), k=900), [rng.randrange(200) for _ in range(900)], [rng.randrange(9) for _ in range(900)]
    got = R.accumulate(s, np.array(values), np.array(term), np.array(doc), 9)
    for k, have in enumerate(items):
        for d in range(9):
            assert got[k, d] == sum(v for v, t, x in zip(values, term, doc) if x == d and t in have)


def test_long_item_is_mined_in_linear_time():
    items = [list(range(0, 30000)), list(range(10, 30010)), list(range(0, 30000, 3))]
    s = R.mine(items, 30010)
    assert s.n_nodes < 40


def test_empty_tables(spark, frame):
    docs, items = frame([(1, "a b")]), spark.createDataFrame([(1, "a"), (2, "?!")], "item_id long, text string")
    assert R.search(spark, docs.where("doc_id < 0"), items).collect() == []
    assert R.search(spark, docs, items.where("item_id < 0")).collect() == []
    assert R.search(spark, docs, items.where("item_id = 2")).collect() == []
    assert found(R.search(spark, docs, items)) == slow([(1, "a b")], [(1, "a"), (2, "?!")])
