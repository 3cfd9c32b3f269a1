from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from churnkit.llm import mixing, weak_quality
from llm_text import edge_rows  # noqa: F401
from test_packing import check
from test_simhash import slow_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows (doc_id, text, source) after each stage but the last, and the result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in C.STAGES:
        out.append(f(spark, out[-1], SF).persist())
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages(stages):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "mixing", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_keeps_what_its_scores_say(stages):
    scored = {r.doc_id: r.quality_keep for r in weak_quality.classify(stages[0]).collect()}
    assert {i for i, *_ in rows(stages[1])} == {i for i, keep in scored.items() if keep}


def test_exact_and_near(stages):
    best = {}
    for i, t, _ in rows(stages[1]):
        best[t] = max(best.get(t, -1), i)
    assert sorted(i for i, *_ in rows(stages[2])) == sorted(best.values())
    assert sorted(i for i, *_ in rows(stages[3])) == sorted({c for _, _, c in slow_components(rows(stages[2]), 4, 4)})


def test_mixing_and_packing(stages):
    plan = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    mixed = rows(stages[4])
    assert Counter(i for i, *_ in mixed) == Counter({i: n for i, n in plan.items() if n})
    assert set(mixed) <= set(rows(stages[3]))
    n, total = check(mixed, stages[5].collect(), 2048)
    assert n <= 1.1 * total / 2048 + 2


def test_run_is_the_stages_one_after_another(spark, stages):
    key = lambda df: sorted(map(str, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    assert key(C.run(spark, SF)) == key(stages[-1])
    assert defaultdict(int, C.__dict__)["ORACLE_SQL"] is None


def brute(spark, docs):
    """Rows after each stage, by plain Python where the stage has a plain definition."""
    from churnkit.llm.simhash import simhash_dedup
    kept = {(r.doc_id, r.text) for r in weak_quality.classify(docs).where("quality_keep").collect()}
    first = [r for r in docs.collect() if (r.doc_id, r.text) in kept]
    best = {}
    for r in first:
        t = r.text or ""
        if t not in best or (best[t].doc_id is None) or (r.doc_id is not None and r.doc_id > best[t].doc_id):
            best[t] = r
    return first, best, simhash_dedup


def test_end_to_end_with_odd_rows(spark, edge_rows, tmp_path):
    """Nulls in any column, repeated rows, clashing and extra columns, through all stages."""
    extra = [(9000 + k, f"a quite ordinary text of some words about number {k} and no more than that", None if k % 2 else "s1") for k in range(30)]
    rows = [*edge_rows, *extra, extra[3], extra[3], (None, extra[4][1], "s1"), (None, "a text whose document has no id at all", None)]
    full = [(i, t, None if n % 9 == 0 else "en", s, None if n % 5 == 0 else len(t or ""), 100.0 + n, f"keep-{n % 3}", n) for n, (i, t, s) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, weak_label double, m_hash string, stays int").repartition(3)
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = {tuple(r) for r in docs.collect()}
    out = [docs]
    for _, f in C.STAGES:
        out.append(f(spark, out[-1], sf).persist())
    for df in out[1:-1]:
        assert df.columns == docs.columns
        assert {tuple(r) for r in df.collect()} <= known  # every value of every column as it was
    first, best, _ = brute(spark, docs)
    assert sorted(map(str, out[1].collect())) == sorted(map(str, first))
    assert sorted((r.text or "") for r in out[2].collect()) == sorted(best)
    assert all(r.doc_id == best[r.text or ""].doc_id for r in out[2].collect())
    assert {r.doc_id for r in out[3].collect()} <= {r.doc_id for r in out[2].collect()}
    taken, pieces = Counter(r.doc_id for r in out[4].collect()), Counter(r.doc_id for r in out[5].where("start = 0").collect())
    assert taken == pieces and sum(taken.values()) > 10
    assert C.run(spark, sf).count() == out[5].count()


def test_empty_table_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []

