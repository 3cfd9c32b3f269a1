"""Evaluation operators E1-E10 and the risk ranking M15.

All curve operators start from ``score_counts``: one aggregation of the
score table to at most 10,001 rows (scores in basis points), with map-side
partial aggregation, so a hot score value never lands whole in one task.
Everything after that works on the small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.functions.columns import fixed, safe_div
from churnkit.functions.ordering import global_index, running_sums
from churnkit.functions.ranks import counting_rank

BP = 10_000
# Fixed values of the reference evaluation.
F2_GRID = (2000, 7001, 500)        # thresholds .20 .. .70 step .05, in basis points
RECALL_GRID = (500, 9501, 100)     # thresholds .05 .. .95 step .01
RECALL_MIN = 0.90
HIST_BINS = 40
ROC_POINTS = 200
OFFICIAL_THRESHOLD = 0.31


def to_bp(prob) -> F.Column:
    c = F.col(prob) if isinstance(prob, str) else prob
    return F.floor(c * F.lit(float(BP)) + F.lit(0.5)).cast("int")


def score_counts(scores: DataFrame, prob: str = "prob_churn", label: str = "churn_real") -> DataFrame:
    """(prob_bp, pos, neg): one row per distinct score in basis points."""
    y = F.col(label)
    return (scores.groupBy(to_bp(prob).alias("prob_bp"))
                  .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")))


def _suffix_counts(sc: DataFrame) -> DataFrame:
    """tp(t) / fp(t) = positives / negatives with score >= t for every t in
    0..10,000 bp: the dense grid (10,001 rows, fixed size) left-joined to the
    score counts, then one suffix-sum window over that bounded table."""
    grid = sc.sparkSession.range(BP + 1).select(F.col("id").cast("int").alias("t_bp"))
    dense = grid.join(sc.withColumnRenamed("prob_bp", "t_bp"), "t_bp", "left").fillna(0, ["pos", "neg"])
    w = Window.orderBy(F.desc("t_bp")).rowsBetween(Window.unboundedPreceding, 0)
    return dense.select("t_bp", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                        F.sum("pos").over(Window.partitionBy()).alias("P"),
                        F.sum("neg").over(Window.partitionBy()).alias("N"))


def _threshold_counts(sc: DataFrame, grid_bp: Sequence[int]) -> DataFrame:
    """tp / fp / P / N at each threshold of the grid (score >= threshold)."""
    wanted = [int(t) for t in grid_bp]
    return (_suffix_counts(sc).where(F.col("t_bp").isin(wanted))
            .select("t_bp", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "P", "N")]))


def _metrics(df: DataFrame, digits: int | None) -> DataFrame:
    tp, fp, P, N = (F.col(c) for c in ("tp", "fp", "P", "N"))
    prec = safe_div(tp, tp + fp)
    rec = safe_div(tp, P)
    f1 = safe_div(F.lit(2.0) * prec * rec, prec + rec)
    f2 = safe_div(F.lit(5.0) * prec * rec, F.lit(4.0) * prec + rec)
    r = (lambda c: fixed(c, digits)) if digits is not None else (lambda c: c)
    return df.select(
        (F.col("t_bp") / F.lit(float(BP))).alias("threshold"),
        tp.alias("tp"), fp.alias("fp"), (N - fp).alias("tn"), (P - tp).alias("fn"),
        r(prec).alias("precision"), r(rec).alias("recall"), r(f1).alias("f1"), r(f2).alias("f2"),
        (tp + fp).alias("abordados"))


def check_threshold(t: float) -> float:
    """A free threshold must lie in (0, 1); it is used with 2 decimals."""
    if not 0.0 < t < 1.0:
        raise ValueError("threshold must lie strictly between 0 and 1")
    return round(t, 2)


def confusion_at(sc: DataFrame, t: float) -> DataFrame:
    """Tp, fp, tn, fn at threshold t (score >= t is positive)."""
    t_bp = int(round(check_threshold(t) * BP))
    return _metrics(_threshold_counts(sc, [t_bp]), 4).select("threshold", "tp", "fp", "tn", "fn")


def metrics_at(sc: DataFrame, t: float) -> DataFrame:
    """Precision, recall, F1, F2 (4 dp, 0 on a zero denominator), approached."""
    t_bp = int(round(check_threshold(t) * BP))
    return _metrics(_threshold_counts(sc, [t_bp]), 4)


def sweep_f2(sc: DataFrame) -> DataFrame:
    """Recall / precision / F1 / F2 (3 dp) for thresholds .20 .. .70."""
    return _metrics(_threshold_counts(sc, list(range(*F2_GRID))), 3).select(
        "threshold", "recall", "precision", "f1", "f2")


def threshold_f2(sc: DataFrame) -> DataFrame:
    """The threshold with the largest F2 on 3-dp values; the first wins ties."""
    return sweep_f2(sc).orderBy(F.desc("f2"), F.asc("threshold")).limit(1) \
                       .select("threshold", "f2")


def sweep_recall(sc: DataFrame) -> DataFrame:
    """Recall, precision and false positives for thresholds .05 .. .95."""
    return _metrics(_threshold_counts(sc, list(range(*RECALL_GRID))), None).select(
        "threshold", fixed("recall", 6).alias("recall"), fixed("precision", 6).alias("precision"),
        "fp", "tp")


def threshold_recall(sc: DataFrame, recall_min: float = RECALL_MIN, strict: bool = True) -> DataFrame:
    """The largest threshold whose recall is still >= recall_min (exact in integers)."""
    num, den = F.lit(int(round(recall_min * 100))), F.lit(100)
    tc = _threshold_counts(sc, list(range(*RECALL_GRID)))
    # recall is 0 when there are no positives (nothing qualifies then)
    ok = tc.where((F.col("P") > 0) & (F.col("tp") * den >= num * F.col("P")))
    res = ok.agg(F.max("t_bp").alias("t_bp")).select(
        (F.col("t_bp") / F.lit(float(BP))).alias("threshold"))
    if strict and res.first()["threshold"] is None:
        raise ValueError("no threshold reaches the required recall")
    return res


def _cumulative(sc: DataFrame) -> DataFrame:
    """Cumulative tp / fp from the highest score down (window over <= 10,001 rows)."""
    w = Window.orderBy(F.desc("prob_bp")).rowsBetween(Window.unboundedPreceding, 0)
    return (sc.select("prob_bp", "pos", "neg",
                      F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                      F.sum("pos").over(Window.partitionBy()).alias("P"),
                      F.sum("neg").over(Window.partitionBy()).alias("N")))


def roc_curve(sc: DataFrame) -> DataFrame:
    """E5: ROC points (origin first), collinear intermediate points dropped."""
    cum = _cumulative(sc)
    w = Window.orderBy(F.desc("prob_bp"))
    pts = cum.select(
        "*", F.row_number().over(w).alias("i"),
        F.lag("pos").over(w).alias("pos_prev"), F.lag("neg").over(w).alias("neg_prev"),
        F.lead("pos").over(w).alias("pos_next"), F.lead("neg").over(w).alias("neg_next"))
    keep = (F.col("pos_prev").isNull() | F.col("pos_next").isNull()
            | (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg")))
    kept = pts.where(keep)
    origin = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).select(
        F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"),
        "P", "N", F.lit(None).cast("double").alias("limiar"))
    body = kept.select("tp", "fp", "P", "N", (F.col("prob_bp") / F.lit(float(BP))).alias("limiar"))
    allp = origin.unionByName(body)
    wo = Window.orderBy(F.asc("fp"), F.asc("tp"))
    return allp.select((F.row_number().over(wo) - 1).cast("int").alias("ponto"),
                       safe_div(F.col("fp"), F.col("N"), None).alias("fpr"),
                       safe_div(F.col("tp"), F.col("P"), None).alias("tpr"), "limiar")


def roc_reduced(sc: DataFrame, points: int = ROC_POINTS) -> DataFrame:
    """E5: at most ``points`` ROC points at indexes (i * (n - 1)) div (points - 1), 4 dp."""
    roc = roc_curve(sc)
    n = roc.count()  # at most 10,002 points
    if n <= points:
        return roc.select(F.col("ponto").alias("indice"), fixed("fpr", 4).alias("fpr"),
                          fixed("tpr", 4).alias("tpr"))
    wanted = sc.sparkSession.range(points).select(
        F.col("id").cast("int").alias("indice"),
        F.expr(f"CAST((id * {n - 1}) div {points - 1} AS INT)").alias("ponto"))
    return (roc.join(F.broadcast(wanted), "ponto")
               .select("indice", fixed("fpr", 4).alias("fpr"), fixed("tpr", 4).alias("tpr")))


def auc_roc(sc: DataFrame) -> DataFrame:
    """Area under ROC, ties count half (pairwise definition)."""
    cum = _cumulative(sc)
    neg_below = F.col("N") - F.col("fp")
    term = F.col("pos").cast("double") * (neg_below.cast("double") + F.col("neg").cast("double") / 2.0)
    return cum.agg(F.try_divide(F.sum(term), F.first("P").cast("double") * F.first("N").cast("double"))
                   .alias("auc_roc"))


def average_precision(sc: DataFrame) -> DataFrame:
    """Sum over thresholds of (recall step) x precision."""
    cum = _cumulative(sc)
    term = (F.col("pos").cast("double") / F.col("P").cast("double")) * \
           (F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double"))
    return cum.agg(F.sum(term).alias("average_precision"))


def exact_metrics(scores: DataFrame, t: float = 0.5, prob: str = "prob_churn", label: str = "churn_real") -> dict[str, float]:
    """recall, precision, F1 at t, AUC-ROC and average precision of raw scores (not cut to basis points).

    Distinct scores are numbered from the highest down and summed level by level
    (``running_sums``), so there is no one-task window; only sums reach the driver.
    """
    y = F.col(label)
    each = scores.groupBy(F.col(prob).alias("p")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    cum = running_sums(global_index(each, [F.desc("p")], "i"), "i", ["pos", "neg"], suffix="_cum")
    s = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                F.sum(F.col("pos") * F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))).alias("ap"),
                F.sum(F.col("neg") * (F.col("pos_cum") - F.col("pos") / 2.0)).alias("area"),
                F.sum(F.when(F.col("p") >= t, F.col("pos")).otherwise(0)).alias("tp"),
                F.sum(F.when(F.col("p") >= t, F.col("neg")).otherwise(0)).alias("fp")).first()
    pos, neg, tp, fp = (float(s[c] or 0) for c in ("P", "N", "tp", "fp"))
    recall, precision = (tp / pos if pos else 0.0), (tp / (tp + fp) if tp + fp else 0.0)
    return {"recall": recall, "precision": precision, "f1": 2 * precision * recall / (precision + recall) if tp else 0.0,
            "roc_auc": float(s["area"] or 0) / (pos * neg) if pos and neg else 0.0, "auc_pr": float(s["ap"] or 0) / pos if pos else 0.0}


def score_histogram(sc: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """Per-class counts in ``bins`` equal bins on [0, 1] (float edges), empty bins kept."""
    step = 1.0 / bins
    k = (F.col("prob_bp") * bins / BP).cast("int")  # bp div (BP / bins)
    s = F.col("prob_bp") / F.lit(float(BP))
    b = F.least(k - F.when(s < k.cast("double") * F.lit(step), 1).otherwise(0), F.lit(bins - 1))
    counts = sc.groupBy(b.alias("bin")).agg(F.sum("neg").alias("ficou"), F.sum("pos").alias("cancelou"))
    grid = sc.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    centre = (F.col("bin").cast("double") * F.lit(step) + (F.col("bin") + 1).cast("double") * F.lit(step)) / 2.0
    return (grid.join(counts, "bin", "left")
                .select("bin", fixed(centre, 3).alias("score"),
                        F.coalesce("ficou", F.lit(0)).cast("long").alias("ficou"),
                        F.coalesce("cancelou", F.lit(0)).cast("long").alias("cancelou")))


def compare_thresholds(sc: DataFrame, labelled: Sequence[tuple[str, float]]) -> DataFrame:
    """Metrics of the same scores at several thresholds, with the change in
    false positives and recall against the first one."""
    grid = [int(round(t * BP)) for _, t in labelled]
    m = _metrics(_threshold_counts(sc, grid), 4)
    names = F.create_map(*[x for (name, t), g in zip(labelled, grid)
                           for x in (F.lit(g / BP), F.lit(name))])
    m = m.select(names[F.col("threshold")].alias("modelo"), "*")
    base = m.where(F.col("threshold") == F.lit(grid[0] / BP)).select(
        F.col("fp").alias("_fp0"), F.col("recall").alias("_r0"))
    return (m.join(F.broadcast(base), how="left")
             .select("modelo", "threshold", "recall", "precision", "fp", "fn", "abordados",
                     (F.col("_fp0") - F.col("fp")).alias("fp_economizados"),
                     fixed(F.col("recall") - F.col("_r0"), 4).alias("delta_recall")))


def compare_models(models: Sequence[tuple[str, DataFrame, float]]) -> DataFrame:
    """Metrics of several models' score counts, each at its own threshold, with the
    change in false positives and recall against the first model."""
    out = None
    for k, (name, sc, t) in enumerate(models):
        m = _metrics(_threshold_counts(sc, [int(round(t * BP))]), 4).select(F.lit(k).alias("_k"), F.lit(name).alias("modelo"), "*")
        out = m if out is None else out.unionByName(m)
    base = out.where("_k = 0").select(F.col("fp").alias("_fp0"), F.col("recall").alias("_r0"))  # one row
    return (out.join(F.broadcast(base), how="left")
               .select("modelo", "threshold", "recall", "precision", "fp", "fn", "abordados",
                       (F.col("_fp0") - F.col("fp")).alias("fp_economizados"),
                       fixed(F.col("recall") - F.col("_r0"), 4).alias("delta_recall")))


def bundle_meta(scores: DataFrame, sc: DataFrame, threshold: float = OFFICIAL_THRESHOLD,
                label: str = "churn_real") -> DataFrame:
    """Test-set summary: AUC, official threshold, size, target rate."""
    auc = auc_roc(sc).first()["auc_roc"]
    return scores.agg(F.count(F.lit(1)).alias("n_teste"),
                      fixed(F.avg(F.col(label).cast("double")), 4).alias("taxa_churn")).select(
        fixed(F.lit(auc), 4).alias("auc"), F.lit(float(threshold)).alias("threshold_oficial"),
        "n_teste", "taxa_churn")


def risk_ranking(scores: DataFrame, key: str = "CustomerID", prob: str = "prob_churn",
                 label: str = "churn_real", upto: int | None = None, limit: int | None = None) -> DataFrame:
    """Scores rounded to 4 dp, ranked 1..n by (score desc, key asc).

    Ranks come from the counts of the 10,001 score values and of id ranges inside
    hot ones: one hash shuffle, no sort of the whole table and no copy of it.
    ``upto`` keeps the best ranks only.
    """
    rounded = scores.select(key, fixed(prob, 4).alias("prob_churn"), F.col(label).alias("churn_real"))
    ranked = counting_rank(rounded.withColumn("_ck_bp", to_bp("prob_churn")), "_ck_bp", key, "rank_risco", limit=limit, upto=upto)
    return ranked.drop("_ck_bp")


TOP_DIRECT_MAX = 100_000


def top_ranked(scores: DataFrame, k: int, key: str = "CustomerID", prob: str = "prob_churn",
               label: str = "churn_real", direct_max: int | None = None) -> DataFrame:
    """The ``k`` best ranks of ``risk_ranking`` without ranking everything.

    For k up to ``direct_max`` this is ``orderBy(...).limit(k)``, which Spark
    runs as a bounded per-task top-k (TakeOrderedAndProject), followed by a
    window over those k rows only; larger k use the ranks by counting.
    """
    rounded = scores.select(key, fixed(prob, 4).alias("prob_churn"), F.col(label).alias("churn_real"))
    return best_ranks(rounded, k, key, direct_max)


def best_ranks(rows: DataFrame, k: int, key: str = "CustomerID", direct_max: int | None = None) -> DataFrame:
    """The ``k`` best of ``rows`` (with ``prob_churn`` of 4 decimals) by (score desc, key asc), all columns, and ``rank_risco``."""
    if k > (TOP_DIRECT_MAX if direct_max is None else direct_max):
        ranked = counting_rank(rows.withColumn("_ck_bp", to_bp("prob_churn")), "_ck_bp", key, "rank_risco", upto=int(k))
        return ranked.drop("_ck_bp")
    order = [F.desc("prob_churn"), F.asc(key)]
    head = rows.orderBy(*order).limit(int(k))
    return head.select("*", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank_risco"))
