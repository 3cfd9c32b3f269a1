"""Lookup layout reads one bucket; digit search equals a scan; curves by signed deltas equal a recount; nested factors need no shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from churnkit.operators import curves as cv
from churnkit.operators import deltas as dl
from churnkit.operators import explain as ex
from churnkit.plans.context import Chain
from churnkit.sources import io as sio
from churnkit.sources import lookup as lk
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def people(spark):
    ids = [*range(0, 3000, 7), 3_000_002, 3_399_994, 12, 121212, -45, 1_000_000_007]
    return spark.createDataFrame([(i, i / 7) for i in dict.fromkeys(ids)], "CustomerID long, x double")


@pytest.fixture
def plan_of(spark):
    """Formatted plans that name the buckets read (a scan prunes buckets anyway, but shows it only so)."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    yield lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_a_lookup_reads_one_bucket(spark, people, tmp_path, plan_of):
    name = lk.write_lookup(people, "CustomerID", buckets=8, path=str(tmp_path / "t"))
    for i in (14, 3_000_002, -45):
        got = lk.lookup(spark, name, "CustomerID", i)
        assert [r["CustomerID"] for r in got.collect()] == [i]
        plan = plan_of(lk.lookup(spark, name, "CustomerID", i))
        assert "SelectedBucketsCount: 1 out of 8" in plan and f"EqualTo(CustomerID,{i})" in plan
    assert lk.lookup(spark, name, "CustomerID", 5).count() == 0
    assert spark.table(name).count() == people.count()
    files = [p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet"]
    assert len(files) <= 8
    import pyarrow.parquet as pq
    for f in files:
        ids = pq.read_table(f).column("CustomerID").to_pylist()
        assert ids == sorted(ids)


def test_digit_search_equals_the_scan(spark, people, tmp_path, plan_of):
    name = lk.write_postings(people, "CustomerID", buckets=8, path=str(tmp_path / "p"))
    every = [r["CustomerID"] for r in people.collect()]
    for typed in ("1", "12", "121", "2121", "3000002", " 99 ", "0000", "-4", "-45", "7", "x1", "9999999", "", "1000000007", "121212"):
        s = typed.strip()
        got = sorted(r["CustomerID"] for r in lk.ids_containing(spark, name, "CustomerID", typed).collect())
        assert got == sorted(i for i in every if s in str(i)), typed
    plan = plan_of(lk.ids_containing(spark, name, "CustomerID", "121"))
    assert "SelectedBucketsCount: 1 out of 8" in plan


def test_empty_lookup(spark, people, tmp_path):
    none = people.where("false")
    assert lk.lookup(spark, lk.write_lookup(none, "CustomerID", 4, str(tmp_path / "t")), "CustomerID", 1).count() == 0
    assert lk.ids_containing(spark, lk.write_postings(none, "CustomerID", 4, str(tmp_path / "p")), "CustomerID", "1").count() == 0


def test_deltas_equal_a_recount(spark):
    rng = random.Random(8)
    now = {i: (rng.randrange(10001) / 10000, rng.randrange(2)) for i in range(500)}
    schema = "CustomerID long, prob_churn double, churn_real int"

    def frame(d):
        return spark.createDataFrame([(i, *v) for i, v in d.items()], schema)

    counts, all_deltas, first = cv.score_counts(frame(now)), [], cv.score_counts(frame(now))
    for _ in range(3):
        new = {i: (rng.choice([0.5, None, rng.randrange(10001) / 10000]), rng.randrange(2)) for i in rng.sample(range(600), 120)}
        d = dl.score_deltas(dl.changes(frame(now), frame(new))).cache()
        all_deltas.append(d)
        counts = dl.apply_deltas(counts, d)
        state = dl.next_state(frame(now), frame(new))
        now = {i: v for i, v in {**now, **new}.items() if v[0] is not None}
        assert sorted(map(tuple, state.collect())) == sorted((i, *v) for i, v in now.items())
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, cv.score_counts(frame(now)).collect()))
    rng.shuffle(all_deltas)  # the order of change sets does not matter
    assert sorted(map(tuple, dl.apply_deltas(first, *all_deltas).collect())) == sorted(map(tuple, counts.collect()))
    assert cv.auc_roc(counts).first() == cv.auc_roc(cv.score_counts(frame(now))).first()


def test_a_row_that_was_never_counted_cannot_be_retracted(spark):
    counts = spark.createDataFrame([(5000, 1, 0)], "prob_bp int, pos long, neg long")
    wrong = spark.createDataFrame([(1, 0.4, 1, None, None)], "CustomerID long, old_prob double, old_label int, new_prob double, new_label int")
    with pytest.raises(Exception, match="below zero"):
        dl.apply_deltas(counts, dl.score_deltas(wrong)).collect()
    gone = spark.createDataFrame([(1, 0.5, 1, None, None), (2, None, None, None, 1)], wrong.schema)
    assert dl.apply_deltas(counts, dl.score_deltas(gone)).collect() == []


def test_factor_documents_without_a_shuffle(spark):
    c = Chain(spark, SF_SMALL)
    docs = ex.factor_documents(c.features, ex.FIXTURE_COEFS, ex.FIXTURE_INTERCEPT)
    want = {r["CustomerID"]: (r["base"], [tuple(f) for f in r["fatores"]]) for r in sio.nested_attributions(c.factors).collect()}
    got = {r["CustomerID"]: (r["base"], [tuple(f) for f in r["fatores"]]) for r in docs.collect()}
    assert got == want and len(got) == 150
    small = spark.createDataFrame([(1, 2.0, 3.0)], "CustomerID long, Handsets double, MonthsInService double")
    plan = ex.factor_documents(small, {"Handsets": 1.0, "MonthsInService": -2.0}, 0.0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_models_are_compared_at_their_own_thresholds(spark):
    a = spark.createDataFrame([(3000, 5, 5), (1000, 5, 85)], "prob_bp int, pos long, neg long")
    b = spark.createDataFrame([(3000, 8, 2), (1000, 2, 88)], "prob_bp int, pos long, neg long")
    rows = cv.compare_models([("a", a, 0.25), ("b", b, 0.30)]).collect()
    assert [(r["modelo"], r["fp"], r["recall"], r["fp_economizados"], r["delta_recall"]) for r in rows] == [("a", 5, 0.5, 0, 0.0), ("b", 2, 0.8, 3, 0.3)]


def test_standardised_columns(spark):
    from churnkit.operators import split as sp
    df = spark.createDataFrame([(1, 1.0, 5), (2, 3.0, 5), (3, 5.0, 5)], "CustomerID long, a double, `b c` long")
    out = sp.standardise(df, sp.standardise_stats(df.where("CustomerID < 3"), ["a", "b c"]), ["a", "b c"])
    assert [tuple(r) for r in out.orderBy("CustomerID").collect()] == [(1, -1.0, 0.0), (2, 1.0, 0.0), (3, 3.0, 0.0)]
