"""Hand-sized edge frames (FIXTURES.md section 3) and operator invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.operators import curves as cv
from churnkit.operators import policy as pol
from churnkit.operators import prep, profile, segments as seg
from churnkit.operators import serving as sv
from churnkit.sources.fixtures import RAW_COLUMNS, subscriber
from conftest import SF_SMALL

SPEC = prep.fixture_spec()


def raw_rows(spark, overrides):
    """Rows of the fixture schema: a complete default row, changed per row."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(f.name, f.dataType, True)
                           for f in subscriber(spark, SF_SMALL).schema.fields])
    default = {
        "CustomerID": 1, "Churn": "No", "MonthlyRevenue": 50.0, "MonthlyMinutes": 300.0,
        "TotalRecurringCharge": 40.0, "DirectorAssistedCalls": 1.0, "OverageMinutes": 0.0,
        "RoamingCalls": 0.0, "PercChangeMinutes": -5.0, "PercChangeRevenues": 1.0,
        "DroppedBlockedCalls": 2.0, "UnansweredCalls": 3.0, "CustomerCareCalls": 1.0,
        "ReceivedCalls": 4.0, "OutboundCalls": 5.0, "InboundCalls": 6.0, "MonthsInService": 12,
        "UniqueSubs": 2, "ActiveSubs": 1, "Handsets": 2.0, "CurrentEquipmentDays": 300.0,
        "RetentionCalls": 0, "AgeHH1": 40.0, "ServiceArea": "A-X", "HandsetPrice": "30",
        "CreditRating": "2-HIGH", "PrizmCode": "ASIA", "Occupation": "BUILDING",
        "MaritalStatus": "Yes", "Homeownership": "Known", "MadeCallToRetentionTeam": "No"}
    rows = []
    for i, o in enumerate(overrides):
        r = dict(default, CustomerID=i + 1)
        r.update(o)
        rows.append(tuple(r[c] for c in RAW_COLUMNS))
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def nulls5(spark):
    billing = {c: None for c in prep.BILLING_COLUMNS}
    return raw_rows(spark, [
        {"MadeCallToRetentionTeam": None, "MaritalStatus": None, "PrizmCode": None, "AgeHH1": None,
         "HandsetPrice": "Unknown", **billing},
        {"MonthlyRevenue": None, "MonthlyMinutes": None, "AgeHH1": 0.0, "HandsetPrice": "abc",
         "ServiceArea": None, "Churn": "Yes"},
        {"CurrentEquipmentDays": -3.0, "PercChangeMinutes": None, "Homeownership": None},
        {"MaritalStatus": "Unknown", "HandsetPrice": "150", "AgeHH1": 60.0},
        {"MaritalStatus": "No", "HandsetPrice": "10", "AgeHH1": 20.0, "CurrentEquipmentDays": 100.0},
    ])


def test_treatment_of_nulls(nulls5):
    treated, params = prep.treat(nulls5, SPEC)
    rows = {r["CustomerID"]: r for r in treated.collect()}
    assert len(rows) == 5
    assert all(v is not None for r in rows.values() for v in r)                  # no nulls left
    assert [rows[i]["MissingBillingInfo"] for i in range(1, 6)] == [1, 0, 0, 0, 0]  # whole block only
    assert rows[1]["MadeCallToRetentionTeam"] == 0                                   # null -> 0
    assert (rows[1]["MaritalStatus_No"], rows[1]["MaritalStatus_Unknown"], rows[1]["MaritalStatus_Yes"]) == (0, 0, 0)
    assert rows[1]["HandsetPriceKnown"] == 0 and rows[2]["HandsetPriceKnown"] == 0
    assert params.medians["HandsetPrice"] == 30.0                                    # median of 30, 30, 150, 10
    assert rows[2]["AgeHH1Known"] == 0 and rows[1]["AgeHH1Known"] == 0
    assert params.medians["AgeHH1"] == 40.0                                          # 40, 60, 20
    assert rows[3]["CurrentEquipmentDays"] == params.medians["CurrentEquipmentDays"] == 300.0
    assert rows[3]["HomeownershipKnown"] == 0
    assert rows[2]["ServiceAreaFreq"] == 0.2                                         # unknown area, 1 of 5
    prep.audit_treated(nulls5, treated, SPEC)                                        # passes


def test_apply_unseen_values(spark, nulls5):
    params = prep.fit(nulls5, SPEC)
    new = raw_rows(spark, [{"ServiceArea": "NEW-AREA", "PrizmCode": "MARS", "CreditRating": "1-URGENT"}])
    r = prep.apply(new, params).first()
    assert r["ServiceAreaFreq"] == 0.0
    assert all(r[f"PrizmCode_{lv}"] == 0 for lv in params.levels["PrizmCode"])


def test_unmapped_ordinal_is_an_error(spark, nulls5):
    params = prep.fit(nulls5, SPEC)
    bad = raw_rows(spark, [{"CreditRating": "9-NOPE"}])
    with pytest.raises(Exception):
        prep.apply(bad, params).collect()


def test_treatment_log_counts(nulls5):
    params = prep.fit(nulls5, SPEC)
    log = {r["coluna"]: r["linhas_afetadas"] for r in prep.treatment_log(nulls5, params).collect()}
    assert log["HandsetPrice"] == 1            # only the literal 'Unknown'
    assert log["AgeHH1"] == 2                  # one zero + one null
    assert log["CurrentEquipmentDays"] == 1
    assert log["ServiceArea"] == 1


def test_constant_column_has_one_bin(spark):
    df = raw_rows(spark, [{"RetentionCalls": 0} for _ in range(6)] + [{"RetentionCalls": 4}])
    out = profile.profile_rate_by_quartile(df, columns=["RetentionCalls"]).collect()
    assert [(r["faixa"], r["contagem"]) for r in out] == [(1, 7)]


def scores_frame(spark, pairs):
    return spark.createDataFrame([(i, p, y) for i, (p, y) in enumerate(pairs)],
                                 "CustomerID long, prob_churn double, churn_real int")


def brute_auc(pairs):
    pos = [p for p, y in pairs if y == 1]
    neg = [p for p, y in pairs if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_ties_and_exact_thresholds(spark):
    pairs = [(0.25, 1), (0.25, 0), (0.31, 1), (0.31, 0), (0.0, 0), (1.0, 1), (0.5, 0), (0.5, 1), (0.1, 1)]
    sc = cv.score_counts(scores_frame(spark, pairs))
    c = cv.confusion_at(sc, 0.25).first()
    assert (c["tp"], c["fp"]) == (4, 3)                                   # on-threshold counts as positive
    assert cv.auc_roc(sc).first()["auc_roc"] == pytest.approx(brute_auc(pairs), abs=1e-15)
    roc = cv.roc_curve(sc).orderBy("ponto").collect()
    assert (roc[0]["fpr"], roc[0]["tpr"]) == (0.0, 0.0)
    assert (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0)


def test_one_class(spark):
    sc = cv.score_counts(scores_frame(spark, [(0.2, 0), (0.7, 0), (0.9, 0)]))
    m = cv.metrics_at(sc, 0.5).first()
    assert (m["precision"], m["recall"], m["f1"], m["f2"]) == (0.0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        cv.threshold_recall(sc)


def test_threshold_recall_is_the_largest(spark):
    rng = np.random.default_rng(3)
    pairs = [(round(float(p), 4), int(rng.random() < p)) for p in rng.random(400)]
    sc = cv.score_counts(scores_frame(spark, pairs))
    t = cv.threshold_recall(sc).first()["threshold"]
    P = sum(y for _, y in pairs)

    def recall(th):
        return sum(1 for p, y in pairs if y == 1 and p >= th) / P
    assert recall(t) >= 0.9 and recall(round(t + 0.01, 2)) < 0.9


def test_threshold_must_be_inside(spark):
    sc = cv.score_counts(scores_frame(spark, [(0.2, 0), (0.7, 1)]))
    for bad in (0.0, 1.0, -0.1):
        with pytest.raises(ValueError):
            cv.metrics_at(sc, bad)


def test_histogram_float_edges(spark):
    # a score exactly on an edge lies in the lower bin when the double edge is above it
    pairs = [(0.075, 1), (0.025, 0), (1.0, 1)]
    h = {r["bin"]: (r["ficou"], r["cancelou"]) for r in cv.score_histogram(cv.score_counts(scores_frame(spark, pairs))).collect()}
    edges = np.linspace(0, 1, 41)
    for p, y in pairs:
        b = min(int(np.searchsorted(edges, p, side="right") - 1), 39)
        assert h[b][y] >= 1
    assert len(h) == 40


def offer_log(spark, rows):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)],
                                 "rodada long, CustomerID long, segmento string, acao string, aceitou int")


@pytest.fixture(scope="module")
def gap_log(spark):
    s1, s2 = seg.SEG_UNHAPPY, seg.SEG_PRICE
    return offer_log(spark, [
        (1, s1, "desconto", 0), (1, s1, "upgrade", 0), (1, s1, "suporte", 0), (1, s1, "bonus", 0),
        (2, s1, "desconto", 0), (2, s1, "upgrade", 1),
        (3, s2, "desconto", 1), (3, s2, "bonus", 1), (4, s2, "desconto", 0), (4, s2, "bonus", 0)])


def test_policy_gap(gap_log):
    counts = pol.policy_counts(gap_log)
    rows = {(r["segmento"], r["acao"]): r for r in counts.collect()}
    assert len(rows) == 20                                                    # zero rows kept
    assert sum(r["tentativas"] for r in rows.values()) == gap_log.count()
    assert rows[(seg.SEG_GENERAL, "bonus")]["taxa_estimada"] == 0.0           # segment with no offers
    order = {(r["segmento"], r["ordem"]): r["acao"] for r in pol.policy_order(counts).collect()}
    assert order[(seg.SEG_PRICE, 1)] == "desconto" and order[(seg.SEG_PRICE, 2)] == "bonus"  # tie: list order


def test_exhausted_and_next_offer(spark, gap_log):
    segs = spark.createDataFrame([(1, seg.SEG_UNHAPPY), (2, seg.SEG_UNHAPPY), (5, seg.SEG_UNHAPPY)],
                                 "CustomerID long, segmento string")
    order = pol.policy_order(pol.policy_counts(gap_log))
    out = {r["CustomerID"]: r for r in sv.next_best_offer(segs, gap_log, order).collect()}
    assert out[1]["proxima_acao"] == sv.MANUAL and out[1]["retido"] == 0      # refused all four
    assert out[2]["retido"] == 1 and out[2]["custo_total"] == 80 and out[2]["proxima_acao"] is None
    best = [r["acao"] for r in order.where((F.col("segmento") == seg.SEG_UNHAPPY) & (F.col("ordem") == 1)).collect()]
    assert out[5]["proxima_acao"] == best[0] and out[5]["tentativas"] == 0    # never contacted


def test_learning_curve_matches_row_by_row(spark):
    rng = np.random.default_rng(11)
    n = 1234
    segs = [seg.SEGMENTS[i] for i in rng.integers(0, 5, n)]
    acts = [pol.ACTIONS[i][0] for i in rng.integers(0, 4, n)]
    acc = [int(x) for x in rng.random(n) < 0.4]
    log = offer_log(spark, [(int(i % 97), s, a, y) for i, (s, a, y) in enumerate(zip(segs, acts, acc))])
    curve = {r["rodada"]: r["taxa_aceite"] for r in pol.learning_curve(log).collect()}
    expect = {t: math.floor(np.mean(acc[max(0, t - 400):t]) * 1e4 + 0.5) / 1e4 for t in range(50, n + 1, 50)}
    assert curve == expect


def test_campaign_segments_sum_to_total(spark):
    from churnkit.plans.context import Chain
    c = Chain(spark, SF_SMALL)
    tot = sv.campaign_total(c.ranked_reco, 100, 600.0).first()
    by = sv.campaign_by_segment(c.ranked_reco, 100, 600.0).collect()
    assert sum(r["clientes"] for r in by) == 100
    assert sum(r["custo"] for r in by) == pytest.approx(tot["custo_esperado"], abs=0.01 * len(by))
    with pytest.raises(ValueError):
        sv.campaign_total(c.ranked_reco, 0, 600.0)
    with pytest.raises(ValueError):
        sv.campaign_total(c.ranked_reco, 10, 0.0)


def test_segment_sizes_sum(spark):
    from churnkit.plans.context import Chain
    c = Chain(spark, SF_SMALL)
    assert sum(r["clientes"] for r in seg.segment_sizes(c.segments).collect()) == c.raw.count()
