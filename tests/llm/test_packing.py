import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from churnkit.llm import packing as P
from churnkit.llm.tokens import tokenizer_path
from llm_text import edge_rows, frame  # noqa: F401


def slow_ffd(sizes, capacity):
    room, out = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        for b, r in enumerate(room):
            if r >= sizes[k]:
                break
        else:
            room.append(capacity)
            b = len(room) - 1
        out[k] = (b, capacity - room[b])
        room[b] -= sizes[k]
    return [out[k] for k in range(len(sizes))]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_tournament_is_first_fit_decreasing(n):
    rng = random.Random(n)
    sizes = [rng.randint(1, 50) for _ in range(n)]
    bins, offsets = P.first_fit_decreasing(np.array(sizes, dtype=np.int64), 50)
    assert list(zip(bins.tolist(), offsets.tolist())) == slow_ffd(sizes, 50)


def check(rows, got, capacity):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in rows]
    want = defaultdict(int)
    for (i, *_), x in zip(rows, ids):
        for s in range(0, len(x), capacity):
            part = x[s:s + capacity]
            want[i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(x)] += 1
    have, bins = defaultdict(int), defaultdict(list)
    for r in got:
        have[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(map(len, ids))


def test_pieces_and_sequences(frame, edge_rows, monkeypatch):
    for group in (8192, 20):
        monkeypatch.setattr(P, "GROUP", group)
        n, total = check(edge_rows, P.pack(frame(edge_rows), capacity=256).collect(), 256)
        assert n <= 1.25 * total / 256 + 3


def test_null_ids_and_special_strings(frame):
    rows = [(None, "a b c"), (None, "a b c"), (3, "x <|endoftext|> y<|startoftext|>"), (4, "TABS\tand\x1cother white space")]
    check(rows, P.pack(frame(rows)).collect(), 2048)


def test_empty(frame):
    assert P.pack(frame([(1, "x")]).where("doc_id < 0")).collect() == []
