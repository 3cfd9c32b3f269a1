import hashlib
from collections import defaultdict

from churnkit.llm.exact import drop_duplicates, exact_dedup
from llm_text import edge_rows, frame  # noqa: F401


def test_against_brute_force(frame, edge_rows):
    rows = [*edge_rows, (None, edge_rows[5][1], "s"), (None, "no id", "s"), (None, "no id", "s")]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    for digest in (True, False):
        got = exact_dedup(frame(rows), prefix=3, digest=digest).collect()
        assert len(got) == len(rows)
        kept = defaultdict(int)
        for r in got:
            text = next(t or "" for i, t, _ in rows if i == r.doc_id and (not digest or hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256)
                        and (r.group_size == len(groups[t or ""])))
            ids = [i for i in groups[text] if i is not None]
            assert r.keep_id == (max(ids) if ids else None) and r.group_size == len(groups[text])
            kept[text] += r.kept
            assert not r.kept or r.doc_id == r.keep_id
        if digest:
            assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)


def test_rows_that_stay(frame, edge_rows):
    df = frame(edge_rows)
    got = drop_duplicates(df)
    rows = got.select("doc_id", "text").collect()
    assert got.columns == df.columns
    assert sorted((r.text or "") for r in rows) == sorted({t or "" for _, t, _ in edge_rows})
    best = {}
    for i, t, _ in edge_rows:
        best[t or ""] = max(best.get(t or "", -1), i)
    assert {(r.doc_id, r.text or "") for r in rows} == {(i, t) for t, i in best.items()}


def test_one_row_that_is_a_third_of_the_table(frame):
    """Rows that repeat id and text are combined before they are shuffled: one of them stays, and no window orders them."""
    rows = [(7, "the very same row", "s")] * 400 + [(i, f"text {i % 300}", "s") for i in range(10, 810)] + [(None, "the very same row", "s")] * 5
    got = exact_dedup(frame(rows, 6), digest=True)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    out = [r for r in got.collect() if r.group_size == 405]
    assert len(out) == 405 and sum(r.kept for r in out) == 1 and {r.keep_id for r in out} == {7}
    assert all(r.doc_id == 7 for r in out if r.kept)


def test_shuffle_path(frame, edge_rows, monkeypatch):
    from churnkit.llm import exact
    want = sorted(map(str, exact_dedup(frame(edge_rows), digest=True).collect()))
    monkeypatch.setattr(exact, "BROADCAST_ROWS", -1)
    assert sorted(map(str, exact_dedup(frame(edge_rows), digest=True).collect())) == want


def test_empty(frame):
    df = frame([(1, "x")]).where("doc_id < 0")
    assert exact_dedup(df, digest=True).collect() == [] and drop_duplicates(df).collect() == []
