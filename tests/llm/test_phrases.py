import hashlib
import random

import numpy as np

from churnkit.llm import phrases as P
from llm_text import frame, prose  # noqa: F401


def phrases_of(text):
    """The bytes of each phrase of each level, by parsing a text whose bytes are all marked."""
    return [set(n.tolist()) for n, _ in P.signatures([text])]


def test_equal_substrings_share_interior_phrases():
    rng = random.Random(1)
    common = prose(rng, 300).encode()
    for shift in range(9):
        a = phrases_of(prose(rng, 40).encode()[:50 + shift] + common + b"end")
        b = phrases_of(b"begin" + common + prose(rng, 50).encode())
        for level in range(3):
            own = phrases_of(common)[level]
            assert len(own & a[level] & b[level]) >= len(own) - 16


def test_levels_shrink_and_neighbours_differ():
    rng = random.Random(2)
    for text in [b"a" * 5000, b"ab" * 3000, b"x", b"xy", b"aab", bytes(range(256)) * 4, prose(rng, 2000).encode(), b"Th " * 4000]:
        sizes = [len(n) for n, _ in P.signatures([text])]
        assert sizes[-1] == 1 and all(b <= (a + 1) / 2 or b == 1 for a, b in zip([len(text), *sizes], sizes))


def test_a_batch_changes_nothing():
    rng = random.Random(3)
    texts = [prose(rng, n).encode() for n in (1, 2, 5, 50, 500, 0, 3000)] + [b"", b"a", b"aa" * 40, b"\xff\x00" * 9]
    together = P.hexed(P.sketches(texts))
    assert together == [P.hexed(P.sketches([t]))[0] for t in texts]
    assert together[5] == "ffff" * P.BINS and P.likeness(P.sketches([b""])[0], P.sketches([b""])[0]) == 1


def test_edits_against_brute_force(frame):
    rng = random.Random(4)
    rows = [(7 * i, prose(rng, rng.choice([0, 1, 3, 40, 200])) + rng.choice(["", "é中", "\U0001f600"])) for i in range(90)]
    rows += [(1000, None), (1001, "tail"), (1001, "tail"), (2001, prose(rng, 6000))]
    got = sorted(P.fingerprint_edits(frame(rows)).collect(), key=lambda r: r.doc_id)
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (r, (i, t)) in enumerate(zip(got, ordered)):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 4
        changed = t[:len(t) - n] + after[:n]
        a, b, c = P.sketches([t.encode()]), P.sketches([changed.encode()]), P.sketches([after.encode()])
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (P.hexed(a)[0], P.hexed(b)[0])
        assert np.isclose(r.near_edited, P.likeness(a[0], b[0])) and np.isclose(r.near_next, P.likeness(a[0], c[0]))
    long = [r for r in got if 1000 < r.n_chars]
    assert np.mean([r.near_edited for r in long]) > 0.6 and np.mean([r.near_next for r in long]) < 0.1


def test_one_row_null_ids_and_empty(frame):
    only = P.fingerprint_edits(frame([(5, "abcdefgh" * 30)])).collect()
    assert len(only) == 1 and only[0].near_next == 1
    rows = [(None, "x" * 50), (None, "words and more words"), (1, "first of all texts")]
    got = P.fingerprint_edits(frame(rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None", "None"]
    assert P.fingerprint_edits(frame([(1, "x")]).where("doc_id < 0")).collect() == []
    alone = {r.doc_id: r.fingerprint for r in P.fingerprints(frame([(1, "first of all texts"), (2, None)])).collect()}
    assert alone[1] == next(r.fingerprint for r in got if r.doc_id == 1) and alone[2] == "ffff" * P.BINS
