"""Offer policy from an accept/refuse log.

The log is ``(rodada, CustomerID, segmento, acao, aceitou)``.  Counters are
a two-level aggregation (map-side partial counts, then at most
segments x actions rows); curves work on per-block sums.
"""

from __future__ import annotations

from collections.abc import Sequence
import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit.functions.columns import fixed, safe_div
from churnkit.functions.ordering import running_sums, trailing_sums
from churnkit.operators.segments import SEGMENTS

# The action dimension (id, name, cost) in list order.
ACTIONS = [
    ("desconto", "Desconto na mensalidade", 30),
    ("upgrade", "Upgrade de aparelho subsidiado", 80),
    ("suporte", "Ligacao proativa do suporte", 8),
    ("bonus", "Pacote de minutos bonus", 15),
]
CURVE_EVERY = 50
CURVE_WINDOW = 400
RISK_REDUCTION_ON_ACCEPT = 0.60


def action_dim(spark: SparkSession, actions=ACTIONS) -> DataFrame:
    """(acao, nome, custo, posicao) - four rows, always broadcast."""
    rows = [(a, n, int(c), i + 1) for i, (a, n, c) in enumerate(actions)]
    return spark.createDataFrame(rows, "acao string, nome string, custo int, posicao int")


def policy_grid(spark: SparkSession, segments: Sequence[str] = SEGMENTS, actions=ACTIONS) -> DataFrame:
    """Every (segment, action) pair of the fixed dimensions (20 rows)."""
    rows = [(s, a, j + 1) for s, (j, (a, _, _)) in product(segments, enumerate(actions))]
    return spark.createDataFrame(rows, "segmento string, acao string, posicao int")


def with_actions(log: DataFrame) -> DataFrame:
    """R4 as a lookup: each offer with the action's name and cost."""
    dim = action_dim(log.sparkSession)
    return log.join(F.broadcast(dim), "acao", "left").select(
        "rodada", "CustomerID", "segmento", "acao", F.col("nome").alias("acao_nome"), "custo", "aceitou")


def policy_counts(log: DataFrame, segments: Sequence[str] = SEGMENTS) -> DataFrame:
    """Trials, accepts and rate (4 dp, 0 when untried) per (segment, action), zero rows kept."""
    counts = log.groupBy("segmento", "acao").agg(
        F.count(F.lit(1)).alias("tentativas"), F.sum(F.col("aceitou").cast("long")).alias("aceites"))
    grid = policy_grid(log.sparkSession, segments)
    # counts has one row per (segment, action) pair of the log: bounded by the dimensions
    return (grid.join(F.broadcast(counts), ["segmento", "acao"], "left")
                .select("segmento", "acao",
                        F.coalesce("tentativas", F.lit(0)).cast("long").alias("tentativas"),
                        F.coalesce("aceites", F.lit(0)).cast("long").alias("aceites"),
                        fixed(safe_div("aceites", "tentativas"), 4).alias("taxa_estimada"),
                        "posicao"))


def policy_order(counts: DataFrame) -> DataFrame:
    """Actions of each segment by rate desc, ties in action-list order."""
    w = Window.partitionBy("segmento").orderBy(F.desc("taxa_estimada"), F.asc("posicao"))
    return counts.select("segmento", "acao", "tentativas", "aceites", "taxa_estimada",
                         F.row_number().over(w).cast("int").alias("ordem"))


def policy_best(order: DataFrame) -> DataFrame:
    """The first action of each segment."""
    return order.where(F.col("ordem") == 1).select("segmento", "acao", "taxa_estimada")


def recommend(segments: DataFrame, best: DataFrame) -> DataFrame:
    """Per customer: segment, best action, its name and expected rate.

    ``best`` has one row per segment (bounded), so it is broadcast.
    """
    dim = action_dim(segments.sparkSession).select("acao", F.col("nome").alias("acao_nome"), "custo")
    b = best.join(F.broadcast(dim), "acao")
    return segments.join(F.broadcast(b), "segmento").select(
        "CustomerID", "segmento", "acao", "acao_nome", F.col("taxa_estimada").alias("taxa_esperada"),
        "custo")


def _blocks(log: DataFrame, every: int) -> DataFrame:
    return log.select(F.floor((F.col("rodada") - 1) / every).cast("long").alias("bloco"), "*")


def learning_curve(log: DataFrame, counts: DataFrame | None = None, every: int = CURVE_EVERY,
                   window: int = CURVE_WINDOW) -> DataFrame:
    """R10 + R11: every ``every`` rounds, acceptance over the last ``window``
    rounds and mean regret so far.

    Regret of a round = best observed rate of its segment minus the observed
    rate of the chosen action (rates in basis points, so sums are exact).
    Trailing windows are a shuffle aggregation, running sums are two-level.
    """
    if window % every:
        raise ValueError("window must be a multiple of the reporting step")
    if counts is None:
        counts = policy_counts(log)
    # regret per (segment, action): a segments x actions table, passed as a literal map
    rates = {(r["segmento"], r["acao"]): int(math.floor(r["taxa_estimada"] * 10000.0 + 0.5))
             for r in counts.select("segmento", "acao", "taxa_estimada").collect()}
    best = {}
    for (sg, _), v in rates.items():
        best[sg] = max(best.get(sg, v), v)
    regret = F.create_map(*[x for (sg, a), v in sorted(rates.items())
                            for x in (F.lit(f"{sg}|{a}"), F.lit(best[sg] - v))])
    key = F.concat_ws("|", F.col("segmento"), F.col("acao"))
    blk = (_blocks(log, every)
           .groupBy("bloco").agg(F.count(F.lit(1)).alias("n"),
                                 F.sum(F.col("aceitou").cast("long")).alias("aceites"),
                                 F.sum(F.coalesce(regret[key], F.lit(0)).cast("long")).alias("regret_bp")))
    blk = blk.where(F.col("n") == every)  # a last incomplete block is not reported
    # one row per 50 rounds, reused by both window forms: cut the lineage once
    blk = blk.checkpoint(eager=True)
    win = trailing_sums(blk, "bloco", ["n", "aceites"], window // every)
    cum = running_sums(win, "bloco", ["regret_bp"])
    rodada = (F.col("bloco") + 1) * every
    return cum.select(rodada.cast("long").alias("rodada"),
                      fixed(F.col("aceites_win") / F.col("n_win"), 4).alias("taxa_aceite"),
                      fixed(F.col("regret_bp_cum") / F.lit(10000.0) / rodada, 4).alias("regret_medio"))


def posterior_mean(counts: DataFrame) -> DataFrame:
    """R12 (deterministic): Beta(1,1) posterior mean (s + 1) / (n + 2)."""
    return counts.select("segmento", "acao", "tentativas", "aceites",
                         fixed((F.col("aceites") + 1) / (F.col("tentativas") + 2), 4).alias("media_posterior"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (SplitMix64's finaliser) of whole arrays."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """One number in (0, 1) per key (uint64): a hash of key, seed and stream, whatever stands beside it."""
    salt = _mixed(np.array([seed], np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(stream))
    return ((_mixed(keys ^ salt) >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53


def gamma_draws(shape: np.ndarray, keys: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """Gamma(shape, 1) per key for shapes of 1 or more, whole arrays at once (Marsaglia and Tsang's rejection).

    Try k of a key uses three numbers of its own; keys that are not accepted try again.
    """
    d = shape - 1.0 / 3.0
    c = 1.0 / np.sqrt(9.0 * d)
    out, open_, k = np.empty(len(keys)), np.arange(len(keys)), 0
    while open_.size:
        some = keys[open_]
        u = [uniforms(some, seed, (stream << 20) + 3 * k + i) for i in range(3)]
        z = np.sqrt(-2.0 * np.log(u[0])) * np.cos(2.0 * np.pi * u[1])
        v = (1.0 + c[open_] * z) ** 3
        ok = v > 0
        ok[ok] = np.log(u[2][ok]) < 0.5 * z[ok] ** 2 + d[open_][ok] * (1.0 - v[ok] + np.log(v[ok]))
        out[open_[ok]] = d[open_][ok] * v[ok]
        open_, k = open_[~ok], k + 1
    return out


def beta_draws(alpha: np.ndarray, beta: np.ndarray, keys: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """Beta(alpha, beta) per key, from two gamma draws."""
    a = gamma_draws(alpha, keys, seed, 2 * stream)
    return a / (a + gamma_draws(beta, keys, seed, 2 * stream + 1))


def thompson_assign(segments: DataFrame, counts: DataFrame, seed: int = 42) -> DataFrame:
    """One explore/exploit choice per customer, batched.

    Each customer draws Beta(accepts + 1, refusals + 1) for every action of its
    segment and takes the largest.  The posterior table (segments x actions)
    is collected once - it is bounded by the two dimensions.  A customer's draws
    are made from hashes of (seed, customer id, action), for whole Arrow batches at
    once, so they are the customer's own under any partitioning, order or retry.
    """
    acts = [a for a, _, _ in ACTIONS]
    segs = list(SEGMENTS)
    # Beta parameters as a (segments + 1) x actions matrix; the last row is the
    # flat prior for a segment outside the dimension
    alpha = np.ones((len(segs) + 1, len(acts)))
    beta = np.ones((len(segs) + 1, len(acts)))
    for r in counts.select("segmento", "acao", "tentativas", "aceites").collect():  # segments x actions rows
        if r["segmento"] in segs and r["acao"] in acts:
            i, j = segs.index(r["segmento"]), acts.index(r["acao"])
            alpha[i, j] = r["aceites"] + 1
            beta[i, j] = r["tentativas"] - r["aceites"] + 1
    acts_arr = np.array(acts, dtype=object)

    def draw(batches):
        for pdf in batches:
            idx = pd.Categorical(pdf["segmento"], categories=segs).codes.astype(int)
            idx[idx < 0] = len(segs)
            keys = pdf["CustomerID"].to_numpy(dtype="int64").view(np.uint64)
            samples = np.column_stack([beta_draws(alpha[idx, j], beta[idx, j], keys, seed, j) for j in range(len(acts))])
            best = samples.argmax(axis=1)
            yield pd.DataFrame({"CustomerID": pdf["CustomerID"].astype("int64"),
                                "segmento": pdf["segmento"],
                                "acao": acts_arr[best],
                                "amostra": samples[np.arange(len(best)), best]})

    schema = T.StructType([T.StructField("CustomerID", T.LongType()),
                           T.StructField("segmento", T.StringType()),
                           T.StructField("acao", T.StringType()),
                           T.StructField("amostra", T.DoubleType())])
    return segments.select("CustomerID", "segmento").mapInPandas(draw, schema)
