import random
import re
from collections import Counter
from itertools import permutations

import pytest

from churnkit.llm import filter_audit as A
from llm_text import edge_rows, frame  # noqa: F401


def slow_facts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))


def slow(rows, labels):
    """(part, order, step) -> the seven counts, one document and one order at a time."""
    docs = []
    for i, t, part in rows:
        t = t or ""
        w, d, c, n, s = slow_facts(t)
        fails = {"A": w < 200, "B": 100 * d < 50 * w, "C": 100 * c > 3 * n, "D": s > 0,
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        good = any(q == 1 for j, q, _ in labels if j == i and i is not None)
        toxic = any(x == 1 for j, _, x in labels if j == i and i is not None)
        docs.append((part or "", {f for f in fails if fails[f]}, good, toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for p in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(p, 1):
                removed = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left = [d for d in left if f not in d[1]]
                gone += removed
                shapley[part, f] += len(removed)
                out[part, "".join(p), step] = [len(left), len(removed), redundant, sum(d[1] == {f} for d in docs if d[0] == part),
                                               sum(d[2] for d in removed), sum(d[3] for d in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    got = df.collect()
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(rows) == len(got)
    return rows


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1 if i % 3 else 0, 1 if i % 4 == 0 else None) for i in range(0, 800, 2)] + [(10, 1, 1), (10, 0, 0), (None, 1, 1), (600, None, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark, edge_rows, labels):
    rng = random.Random(3)
    rows = [*edge_rows, (None, edge_rows[5][1], "s1"), (None, "no id", None), (None, "no id", None)]
    rows += [(900 + k, " ".join(rng.choices(["Aa", "b#", "c", "D", "ñÑ"] + [f"w{x}" for x in range(rng.choice([5, 300]))], k=rng.choice([150, 199, 200, 260]))),
              rng.choice(["s1", "s2", ""])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as id", "2 as mask", "3 as part", "4 as good", "'x' as sha")
    assert found(A.audit(df.repartition(3), labels[1])) == slow(rows, labels[0])


def test_transducer():
    rng = random.Random(5)
    texts = ["", " ", "\n\x0b", "a", "A#", "É ñ 中文😀 ñ É", "x" * 300 + " " + "x" * 300 + " " + "x" * 299 + "y", "x" * 300, "\x1c \x00 a\x00", "   ",
             "q" * 5000 + " " + "q" * 5000, "same same  same\tsame"]
    texts += ["".join(rng.choices("aAbB# \t\né中|", k=rng.randrange(200))) for _ in range(300)]
    texts += [" ".join("abcdefgh"[:rng.randrange(1, 9)] * rng.randrange(1, 9) for _ in range(400)) for _ in range(20)]
    got = A.measure([t.encode() for t in texts])
    assert [tuple(x) for x in got.T.tolist()] == [slow_facts(t) for t in texts]
    for t in texts[:40]:  # a text's counts don't depend on its neighbours
        assert tuple(A.measure([t.encode()])[:, 0].tolist()) == slow_facts(t)


def test_equal_hashes_are_told_apart(monkeypatch):
    """With every hash the same, the table still counts right: the spans' bytes decide."""
    real = A._Spans.__init__

    def all_alike(self, *a):
        real(self, *a)
        self.hash[:] = 7

    monkeypatch.setattr(A._Spans, "__init__", all_alike)
    texts = ["one two three two twofoldly twofoldles twofoldly", "one", "two one"]
    assert A.measure([t.encode() for t in texts])[1].tolist() == [5, 1, 2]


def test_long_texts_are_read_in_turn(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 20)
    rows = [(k, "word " * k + "z" * (k % 5), "x") for k in range(30)]
    got = A.signals(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)).collect()
    assert {r.id: (r.n_words, r.n_distinct, r.n_capitals, r.n_points, r.n_symbols) for r in got} == {i: slow_facts(t) for i, t, _ in rows}


def test_empty_tables(spark, labels):
    df = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert A.audit(df.where("doc_id < 0"), labels[1]).collect() == []
    assert found(A.audit(df, labels[1].where("doc_id < 0"))) == slow([(1, "a", None)], [])
