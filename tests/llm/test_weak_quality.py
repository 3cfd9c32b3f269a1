import math
import random
import re
import string

import numpy as np
import pytest

from churnkit.llm import weak_quality as W
from llm_text import frame, prose  # noqa: F401


def corpus(rng, n):
    rows = []
    for i in range(n):
        text = "the of and " + ". ".join(prose(rng, rng.randint(20, 60)) + " in that is the" for _ in range(3)) + "."
        kind = i % 8
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 1:
            text = " ".join(w + rng.choice(["%%%", "###", "$$$"]) for w in text.split())
        elif kind == 2:
            text = " | ".join(text.split())
        elif kind == 3:
            text = " ".join([prose(rng, 1)] * 200)
        rows.append((i, text, "bad" if kind < 4 and kind % 2 == 0 or kind in (1, 3) else "good"))
    return rows


def slow_votes(t):
    """The twelve labellers, one by one, from their description."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(ws)
    marks = set(string.punctuation)
    up, low = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)

    def vote(known, x, good, bad):
        return 0 if not known else 1 if x > bad else 2 if x <= good else 0

    def share(k):
        return k / n if n else 0

    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    blocks = [ws[k:k + 50] for k in range(0, n, 50)]
    blocks = [x for x in blocks if len(x) >= 25]
    fresh_words = sum(len(set(x)) for x in blocks) / sum(map(len, blocks)) if blocks else 0
    shouted = [w for w in ws if len(w.encode()) > 2 and re.search("[A-Z]", w) and not re.search("[a-z]", w)]
    return [
        vote(n >= 5, share(len(re.findall(r"[#$%&*|<>{}~^\\]", t))), 0.02, 0.1),
        vote(n >= 5, share(len(re.findall(r"[#$%&*|<>{}~^\\]{2,}", t))), 0.01, 0.1),
        vote(n >= 5, share(t.count("|")), 0.01, 0.1),
        vote(n >= 20, share(sum(set(w) <= marks for w in ws)), 0.02, 0.1),
        vote(up + low >= 20, up / max(1, up + low), 0.15, 0.3),
        vote(n >= 5, share(len(shouted)), 0.05, 0.2),
        vote(n >= 5, share(len(re.findall("[!?]", t))), 0.05, 0.2),
        vote(n >= 5, sum(x == y for x, y in zip(ws, ws[1:])) / max(1, n - 1), 0.05, 0.2),
        vote(bool(blocks), 1 - fresh_words, 0.4, 0.6),
        vote(t.count("\n") >= 4, 1 - len(set(lines)) / len(lines) if lines else 0, 0.2, 0.8),
        1 if not ws else 0,
        1 if all(c in marks or c in " \t\n\r\x0b\x0c" for c in t) else 0]


def slow_em(votes, kinds, rounds):
    """Posterior of good of each document, document by document and class by class."""
    names = list(dict.fromkeys(kinds))
    post = []
    for v in votes:
        shares = []
        for name in names:
            mine = [x for x, k in zip(v, kinds) if k == name and x]
            shares.append(sum(x == 1 for x in mine) / len(mine) if mine else 0.0)
        p = [math.prod(1 - x for x in shares), *[x * x for x in shares]]
        post.append([x / sum(p) for x in p])
    for _ in range(rounds):
        size = [sum(p[c] for p in post) for c in range(len(names) + 1)]
        prior = [(x + 1) / (len(votes) + len(names) + 1) for x in size]
        rate = []
        for j, k in enumerate(kinds):
            row = []
            for c in range(len(names) + 1):
                yes, no = (0.2, 9.8) if c == 0 else (7.0, 3.0) if names[c - 1] == k else (1.0, 9.0)
                for v, p in zip(votes, post):
                    yes += p[c] * (v[j] == 1)
                    no += p[c] * (v[j] == 2)
                row.append(yes / (yes + no))
            rate.append(row)
        for d, v in enumerate(votes):
            p = [prior[c] * math.prod((rate[j][c] if x == 1 else 1 - rate[j][c]) for j, x in enumerate(v) if x) for c in range(len(names) + 1)]
            post[d] = [x / sum(p) for x in p]
    return [p[0] for p in post]


def made_up(kinds, fire, error, n=30_000, seed=5):
    """Votes of labellers with known rates, the truth, and what the best rule (true rates known) decides."""
    rng = np.random.default_rng(seed)
    names = list(dict.fromkeys(kinds))
    truth = np.where(rng.random(n) < 0.8, 0, 1 + rng.integers(0, len(names), n))
    rate = np.full((len(kinds), len(names) + 1), error)
    for j, k in enumerate(kinds):
        rate[j, 1 + names.index(k)] = fire[j]
    bad = rng.random((n, len(kinds))) < rate[:, truth].T
    votes = np.where(rng.random(bad.shape) < 0.1, W.ABSTAIN, np.where(bad, W.BAD, W.GOOD))
    prior = np.array([0.8, *[0.2 / len(names)] * len(names)])
    logs = np.log(prior) + (votes == W.BAD) @ np.log(rate) + (votes == W.GOOD) @ np.log(1 - rate)
    return votes, truth == 0, logs[:, 0] > np.log(np.exp(logs[:, 1:]).sum(axis=1)), rate


def em(votes, kinds, **more):
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, rate, prior = W.fit_labellers(patterns, counts.astype(float), kinds, **more)
    return good[inverse.ravel()], rate, prior


@pytest.mark.parametrize("error", [0.0001, 0.01, 0.05])
@pytest.mark.parametrize("kinds, fire", [(["one"] * 8, [0.9] * 8), (["one"] * 8, [0.5, 0.4, 0.6, 0.3, 0.5, 0.4, 0.5, 0.3]),
                                         (["a", "b", "c"] * 4, [0.9] * 12)])
def test_em_decides_as_well_as_the_best_rule(kinds, fire, error):
    votes, truth, best, true_rate = made_up(kinds, fire, error)
    good, rate, prior = em(votes, kinds)
    assert ((good > 0.5) == truth).mean() > (best == truth).mean() - 0.01
    assert np.abs(rate[:, 0] - error).max() < 0.01 and abs(prior[0] - 0.8) < 0.02
    assert np.abs(rate - true_rate).max() < 0.06
    if error == 0.05:  # a single bad vote is outvoted, unlike by the rule that any bad vote is enough
        any_bad = (votes == W.BAD).any(axis=1)
        assert (any_bad & (good > 0.5)).sum() > 0.2 * len(votes) and ((~any_bad) == truth).mean() < 0.8


def test_em_equals_a_slow_one():
    kinds = ["a", "a", "b", "b", "c"]
    votes = made_up(kinds, [0.8, 0.7, 0.9, 0.6, 0.8], 0.03, n=300)[0]
    got = em(votes, kinds, rounds=40, until=0)[0]
    assert np.allclose(got, slow_em(votes.tolist(), kinds, 40), atol=1e-9)


def test_votes_follow_their_description():
    rng = random.Random(9)
    texts = [t for _, t, _ in corpus(rng, 160)] + ["", " \n", "!!! ??? ...", "a | b | c | d | e | f", "É È " * 30, "A" * 300, "x\n" * 30, "one two\n" * 12, "5 5 5 5 5"]
    texts += [" ".join(rng.choices(["a", "B!", "CDE", "f?", "##", "|", "word", "x" * 60], k=rng.randrange(120))) for _ in range(200)]
    for t in texts:
        assert W.votes(t.encode()) == slow_votes(t), t[:80]


def test_bad_documents_go_and_good_ones_stay(frame):
    rows = corpus(random.Random(3), 480)
    df = frame(rows)
    got = W.classify(df).collect()
    assert len(got) == len(rows)
    right = sum(r.quality_keep == (r.source == "good") for r in got)
    assert right >= 0.98 * len(rows) and all(r.quality_keep for r in got if r.source == "good")
    kept = W.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r.quality_keep for r in got)


def test_weak_labels_against_slow_votes_and_em(frame):
    rows = corpus(random.Random(4), 120) + [(900, None, "s"), (901, "", "s"), (None, "a null id", "s"), (5, "again", "s"), (5, "again", "s"), (902, "é" * 4000, "s")]
    slow = slow_em([slow_votes(t or "") for _, t, _ in rows], W.KINDS, 400)
    want = {(i, t): g for (i, t, _), g in zip(rows, slow)}
    got = W.classify(frame(rows)).collect()
    assert len(got) == len(rows)
    assert all(abs(r.weak_label - want[r.doc_id, r.text]) < 1e-6 for r in got)


def test_scores_of_documents_that_were_not_fitted(frame):
    """Held out: the scorer, fitted on 200 documents' weak labels, is right on the others."""
    rows = corpus(random.Random(6), 800)
    got = W.classify(frame(rows), fit_rows=200).collect()
    assert sum(r.quality_keep == (r.source == "good") for r in got) > 0.97 * len(rows)


def test_columns_named_like_the_classifiers_keep_their_values(spark):
    rows = [(i, t, 7.0 + i, "kept", i % 2 == 0) for i, t, _ in corpus(random.Random(7), 80)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, weak_label double, Quality_Score string, quality_keep boolean")
    kept = W.keep_good(df)
    assert kept.columns == df.columns
    got = [tuple(r) for r in kept.collect()]
    assert 20 < len(got) < 80 and set(got) <= {tuple(r) for r in rows}
    assert {r.doc_id for r in W.classify(df.drop("weak_label", "Quality_Score", "quality_keep")).where("quality_keep").collect()} == {r[0] for r in got}


def test_the_sample_is_bounded(frame):
    rows = corpus(random.Random(5), 160)
    got = W.classify(frame(rows), fit_rows=40).collect()
    assert len(got) == len(rows) and sum(r.quality_keep == (r.source == "good") for r in got) > 0.85 * len(rows)


def test_empty(frame):
    df = frame([(1, "x", "s")]).where("doc_id < 0")
    assert W.classify(df).collect() == [] and W.keep_good(df).collect() == []
