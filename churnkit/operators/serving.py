"""Serving and campaign analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.functions.columns import fixed
from churnkit.functions.heavy import heavy_keys, heavy_split_join
from churnkit.operators.policy import RISK_REDUCTION_ON_ACCEPT, action_dim

DETAIL_TOP = 1000
QUEUE_SIZE = 200
PREVIEW_ROWS = 100
MANUAL = "encaminhamento_manual"
MAX_LTV = 100_000.0


def _bp(c) -> F.Column:
    return F.floor(F.col(c) * F.lit(10000.0) + F.lit(0.5)).cast("long")


def client_detail(ranking: DataFrame, reco: DataFrame, factors: DataFrame,
                  top: int = DETAIL_TOP) -> DataFrame:
    """G1: the ``top`` highest risks with segment, action and top factors.

    Customers lacking a recommendation or factors are dropped (inner joins),
    their rank numbers stay as gaps.  Flat form: one row per factor.
    """
    head = ranking.where(F.col("rank_risco") <= top).select(
        "CustomerID", F.col("prob_churn").alias("prob"), F.col("rank_risco").alias("rank"))
    with_reco = head.join(reco.select("CustomerID", "segmento", "acao", "acao_nome", "taxa_esperada"),
                          "CustomerID")
    return with_reco.join(factors.select("CustomerID", "ordem", "variavel", "rotulo", "shap", "valor"),
                          "CustomerID")


def client_detail_nested(detail: DataFrame) -> DataFrame:
    """G1 nested: one row per customer, factors as an ordered array of structs."""
    f = F.struct("ordem", "variavel", "rotulo", "shap", "valor")
    return (detail.groupBy("CustomerID", "prob", "rank", "segmento", "acao", "acao_nome", "taxa_esperada")
                  .agg(F.array_sort(F.collect_list(f)).alias("fatores")))


def retention_queue(detail: DataFrame, size: int = QUEUE_SIZE) -> DataFrame:
    """The ``size`` best ranks of the detail table, six columns."""
    people = detail.select("CustomerID", "prob", "rank", "segmento", "acao_nome", "taxa_esperada").distinct()
    return people.orderBy("rank").limit(size)


def queue_search(queue: DataFrame, typed: str) -> DataFrame:
    """Rows whose id contains the typed digits (trimmed); all rows when empty."""
    s = (typed or "").strip()
    if not s:
        return queue
    return queue.where(F.col("CustomerID").cast("string").contains(s))


def client_lookup(detail: DataFrame, customer_id: int, strict: bool = False) -> DataFrame:
    """One customer's detail; empty (or an error when ``strict``) if not found."""
    out = detail.where(F.col("CustomerID") == F.lit(int(customer_id)))
    if strict and out.limit(1).count() == 0:
        raise KeyError(f"customer {customer_id} is outside the detailed top of the ranking")
    return out


def offer_outcome(log: DataFrame, scores: DataFrame, reduction: float = RISK_REDUCTION_ON_ACCEPT) -> DataFrame:
    """Per offer: cost, risk before, risk after (cut by ``reduction`` when accepted).

    Offers of unknown customers or actions are rejected (inner joins).  A customer
    with a large share of the offers is split over several tasks.
    """
    dim = action_dim(log.sparkSession).select("acao", F.col("nome").alias("acao_nome"), "custo")
    risk = fixed("prob_churn", 4)
    known = log.select("rodada", "CustomerID", "segmento", "acao", "aceitou").join(F.broadcast(dim), "acao")
    heavy = heavy_keys(log, "CustomerID")
    return (heavy_split_join(known, scores.select("CustomerID", risk.alias("risco_antes")), "CustomerID", ["rodada"], heavy=heavy)
               .select("rodada", "CustomerID", "segmento", "acao", "acao_nome", "custo", "aceitou",
                       "risco_antes",
                       F.when(F.col("aceitou") == 1,
                              fixed(F.col("risco_antes") * F.lit(1.0 - reduction), 4))
                        .otherwise(F.col("risco_antes")).alias("risco_depois")))


#: what is kept per customer for G6; ``tentadas`` has a bit for each action in list order
OFFER_STATE = "CustomerID long, segmento string, retido int, custo_total long, tentativas long, tentadas int"


def offer_state(log: DataFrame) -> DataFrame:
    """Per customer of a log (a whole one or an increment): retained, cost of accepted offers, offers, actions tried.

    All four combine by max, sum, sum and or, so increments can be merged."""
    from churnkit.operators.policy import ACTIONS
    cost = F.create_map(*[x for a, _, c in ACTIONS for x in (F.lit(a), F.lit(int(c)))])
    bit = F.create_map(*[x for k, (a, _, _) in enumerate(ACTIONS) for x in (F.lit(a), F.lit(1 << k))])
    return log.groupBy("CustomerID").agg(
        F.max("aceitou").cast("int").alias("retido"),
        F.sum(F.when(F.col("aceitou") == 1, cost[F.col("acao")]).otherwise(0)).cast("long").alias("custo_total"),
        F.count(F.lit(1)).alias("tentativas"), F.bit_or(bit[F.col("acao")]).cast("int").alias("tentadas"))


def merge_offer_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """State rows after an increment; customers that the table lacks are not added."""
    n = new.select("CustomerID", *[F.col(c).alias(f"n_{c}") for c in ("retido", "custo_total", "tentativas", "tentadas")])
    return old.join(n, "CustomerID", "left").select(
        "CustomerID", "segmento", F.greatest("retido", F.coalesce("n_retido", F.lit(0))).cast("int").alias("retido"),
        (F.col("custo_total") + F.coalesce("n_custo_total", F.lit(0))).cast("long").alias("custo_total"),
        (F.col("tentativas") + F.coalesce("n_tentativas", F.lit(0))).cast("long").alias("tentativas"),
        F.col("tentadas").bitwiseOR(F.coalesce("n_tentadas", F.lit(0))).cast("int").alias("tentadas"))


def next_offer_of(state: DataFrame, order: DataFrame) -> DataFrame:
    """The next action of each state row: the first in the learned order not yet tried, manual handling when none is left."""
    from churnkit.operators.policy import ACTIONS
    place = {a: k for k, (a, _, _) in enumerate(ACTIONS)}
    seq: dict[str, list[tuple[int, str]]] = {}
    for r in order.select("segmento", "acao", "ordem").collect():  # segments x actions rows
        seq.setdefault(r["segmento"], []).append((r["ordem"], r["acao"]))
    next_ = F.lit(None).cast("string")
    for sg, actions in sorted(seq.items()):
        first = F.coalesce(*[F.when(F.col("tentadas").bitwiseAND(F.lit(1 << place[a])) == 0, F.lit(a)) for _, a in sorted(actions)])
        next_ = F.when(F.col("segmento") == sg, first).otherwise(next_)
    return state.select("CustomerID", "segmento", "retido", "custo_total", "tentativas",
                        F.when(F.col("retido") == 1, F.lit(None).cast("string")).otherwise(F.coalesce(next_, F.lit(MANUAL))).alias("proxima_acao"))


def never_contacted(segments: DataFrame) -> DataFrame:
    """State rows of customers without offers."""
    return segments.select("CustomerID", "segmento", F.lit(0).alias("retido"), F.lit(0).cast("long").alias("custo_total"),
                           F.lit(0).cast("long").alias("tentativas"), F.lit(0).alias("tentadas"))


def next_best_offer(segments: DataFrame, log: DataFrame, order: DataFrame) -> DataFrame:
    """Per customer: retained if any accept, cost of accepted offers, and the
    next action - the first in the learned order not yet tried, or manual
    handling when none is left.  Customers never contacted get the best action.

    One aggregation per customer; the tried actions are a bit set.
    """
    return next_offer_of(merge_offer_state(never_contacted(segments), offer_state(log)), order)


def _campaign_cells(ranked_reco: DataFrame, top_n: int, ltv: float) -> DataFrame:
    """Exact integer sums of the ``top_n`` best ranks per segment and action, as a local table.

    ``ranked_reco``: recommendations with ``rank_risco``, all of them or at least
    the ``top_n`` best.  Only segments x actions rows reach the driver, which
    says there whether so many customers could be chosen.
    """
    if not 0 < ltv <= MAX_LTV:
        raise ValueError("ltv out of range")
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    # scores and rates have 4 decimals
    head = ranked_reco.where(F.col("rank_risco") <= top_n).select(
        "segmento", "acao_nome", _bp("prob_churn").alias("p_bp"), _bp("taxa_esperada").alias("r_bp"), F.col("custo").cast("long").alias("custo"))
    cells = head.groupBy("segmento", "acao_nome").agg(
        F.count(F.lit(1)).alias("clientes"), F.sum("r_bp").alias("aceites_u"), F.sum(F.col("p_bp") * F.col("r_bp")).alias("salvos_u"),
        F.sum("p_bp").alias("perdidos_u"), F.sum(F.col("custo") * F.col("r_bp")).alias("custo_u"))
    rows = cells.collect()  # segments x actions rows
    chosen = sum(r["clientes"] for r in rows)
    if chosen < top_n:
        raise ValueError(f"top_n must lie between 1 and {chosen}")
    return ranked_reco.sparkSession.createDataFrame(rows, cells.schema)


def campaign_total(ranked_reco: DataFrame, top_n: int = 500, ltv: float = 600.0) -> DataFrame:
    """Expected accepts, customers saved, cost, preserved revenue and ROI of
    offering the recommended action to the ``top_n`` highest risks."""
    sums = ("aceites_u", "salvos_u", "perdidos_u", "custo_u")
    a = _campaign_cells(ranked_reco, top_n, ltv).agg(*[F.sum(c).alias(c) for c in sums])
    salvos = F.col("salvos_u") / F.lit(1e8)
    custo = F.col("custo_u") / F.lit(1e4)
    receita = salvos * F.lit(float(ltv))
    return a.select(F.lit(int(top_n)).alias("top_n"), F.lit(float(ltv)).alias("ltv"),
                    fixed(F.col("aceites_u") / F.lit(1e4), 1).alias("aceites_esperados"),
                    fixed(salvos, 1).alias("salvos_esperados"),
                    fixed(F.col("perdidos_u") / F.lit(1e4), 1).alias("perdidos_sem_acao"),
                    fixed(custo, 2).alias("custo_esperado"),
                    fixed(receita, 2).alias("receita_preservada"),
                    fixed(F.when(custo != 0, (receita - custo) / custo).otherwise(F.lit(0.0)), 2).alias("roi"))


def campaign_by_segment(ranked_reco: DataFrame, top_n: int = 500, ltv: float = 600.0) -> DataFrame:
    """The same per segment (and its action), most customers first."""
    return (_campaign_cells(ranked_reco, top_n, ltv)
            .select("segmento", "acao_nome", "clientes",
                    fixed(F.col("aceites_u") / F.lit(1e4), 1).alias("aceites_esperados"),
                    fixed(F.col("salvos_u") / F.lit(1e8), 1).alias("salvos_esperados"),
                    fixed(F.col("custo_u") / F.lit(1e4), 2).alias("custo"))
            .orderBy(F.desc("clientes"), "segmento"))


def ranking_preview(ranking: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``rows`` of a ranking (full or top-k)."""
    return ranking.where(F.col("rank_risco") <= rows)


def factor_scale(factors: DataFrame, floor: float = 0.01) -> DataFrame:
    """Each factor's size relative to the customer's largest one (at least ``floor``).

    The largest one comes with each factor (``maior``), from the row it was made in.
    """
    m = F.greatest(F.col("maior"), F.lit(floor))
    return factors.select("CustomerID", "variavel", "shap", fixed(F.abs("shap") / m, 4).alias("escala"))
