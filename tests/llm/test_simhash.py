import random

import numpy as np
import pytest
import xxhash

from churnkit.llm import simhash as S
from llm_text import edge_rows, frame  # noqa: F401


def slow_fingerprint(text, n):
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, n, bits):
    fps = [slow_fingerprint(t or "", n) for _, t, *_ in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                part[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, ((d, *_), f) in enumerate(zip(rows, fps))), key=str)


def test_spark_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('a b c d')").first()[0] & (2**64 - 1)
    assert got == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 7])
def test_pairs_within_the_distance_share_a_cell(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 2**64, 300, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for p in rng.choice(64, rng.integers(0, bits + 1), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(p)
    ca, ia, pa = S.cells_of(a, bits)
    cb, ib, pb = S.cells_of(b, bits)
    where = [set() for _ in a]
    for c, i, p in zip(ca.tolist(), ia.tolist(), pa.tolist()):
        where[i].add((c, p))
    met = [False] * len(a)
    for c, i, p in zip(cb.tolist(), ib.tolist(), pb.tolist()):
        met[i] |= (c, False) in where[i] or (not p and (c, True) in where[i])
    assert all(met)


def test_links_in_a_dense_cell_keep_components():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    near = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(12) for b in range(12)]))
    a, b = S.links_in_cell(near, near, 4)
    assert len(a) < 8 * len(near)
    part = {int(x): int(x) for x in near}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        part[find(x)] = find(y)
    for x in near.tolist():
        for y in near.tolist():
            if (x ^ y).bit_count() <= 4:
                assert find(x) == find(y)


def test_against_brute_force(frame, edge_rows):
    rows = [*edge_rows, (None, "only here with no id at all now"), (None, edge_rows[7][1], "s1")]
    got = S.simhash_dedup(frame(rows), shingle=4, max_bits=4).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == slow_components(rows, 4, 4)


def test_tiles_of_a_large_cell(frame, edge_rows, monkeypatch):
    monkeypatch.setattr(S, "TILE", 4)
    got = S.simhash_dedup(frame(edge_rows), shingle=2, max_bits=6).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == slow_components(edge_rows, 2, 6)


def test_chain_of_links(spark):
    from churnkit.llm.graph import components
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = [(a, b) for a, b in zip(order, order[1:])] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in order) and all(got[i] == 1000 for i in range(1000, 1101)) and all(got[5000 + i] == 5000 for i in range(300))


def test_one_of_each_component_stays(frame, edge_rows):
    kept = S.keep_one(frame(edge_rows))
    ids = [r.doc_id for r in kept.collect()]
    smallest = {c for _, _, c in slow_components(edge_rows, 4, 4)}
    assert set(ids) == smallest and kept.columns == frame(edge_rows).columns


def test_empty(frame):
    df = frame([(1, "x")]).where("doc_id < 0")
    assert S.simhash_dedup(df).collect() == [] and S.keep_one(df).collect() == []
