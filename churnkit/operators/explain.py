"""Explanation operators X1-X4.

Attributions are produced per input row; the top-k per customer is taken
inside the row (sorting a k-element array), so no shuffle is needed to rank
a customer's factors.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.columns import fixed
from churnkit.functions.labels import label_of, with_labels

TOP_FACTORS = 5
TOP_GLOBAL = 15
# Fixture model: a literal coefficient for every feature column.
FIXTURE_COEFS = {
    "MonthlyRevenue": 0.004, "MonthlyMinutes": -0.0006, "TotalRecurringCharge": -0.003, "DirectorAssistedCalls": 0.01,
    "OverageMinutes": 0.007, "RoamingCalls": 0.03, "PercChangeMinutes": -0.0009, "PercChangeRevenues": 0.0002,
    "DroppedBlockedCalls": 0.015, "UnansweredCalls": 0.012, "CustomerCareCalls": -0.02, "ReceivedCalls": -0.04,
    "OutboundCalls": -0.03, "InboundCalls": 0.02, "MonthsInService": -0.011, "UniqueSubs": 0.12, "ActiveSubs": -0.09,
    "Handsets": 0.035, "CurrentEquipmentDays": 0.0012, "RetentionCalls": 0.14, "AgeHH1": -0.006, "HandsetPrice": -0.0045,
    "CreditRating": 0.05, "MadeCallToRetentionTeam": 0.33, "HomeownershipKnown": -0.08, "MaritalStatus_No": 0.07,
    "MaritalStatus_Unknown": 0.045, "MaritalStatus_Yes": -0.06, "HandsetPriceKnown": 0.11, "AgeHH1Known": -0.13,
    "MissingBillingInfo": 0.9, "PrizmCode_AFRICA": 0.21, "PrizmCode_AMERICA": -0.17, "PrizmCode_ASIA": -0.4,
    "PrizmCode_EUROPE": 0.19, "PrizmCode_MIDDLE EAST": 0.16, "Occupation_AUTOMOBILE": 0.23, "Occupation_BUILDING": -0.27,
    "Occupation_FURNITURE": 0.31, "Occupation_HOUSEHOLD": -0.22, "Occupation_MACHINERY": 0.26, "ServiceAreaFreq": 3.0,
    "ReceitaPorMinuto": 1.5, "RazaoOverage": 4.0, "ReceitaPorMes": 0.018, "FalhasPorChamada": 0.8,
    "NaoAtendidasPorChamada": 0.37, "CareCallsPorMes": 2.0, "RetentionPorMes": 1.7, "IdadeAparelhoMeses": 0.05,
    "RazaoAparelhoContrato": 0.42, "FimFidelizacao": 0.65, "RazaoSubsAtivos": -0.75, "QuedaUso": 0.0016}
FIXTURE_INTERCEPT = -1.0


def linear_base(x: DataFrame, coefs: Mapping[str, float], intercept: float) -> tuple[dict, float]:
    """Column means (one aggregate) and the base value intercept + sum coef * mean."""
    row = x.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in coefs]).first()
    means = {c: float(row[c] or 0.0) for c in coefs}
    return means, intercept + sum(coefs[c] * means[c] for c in coefs)


def _contrib_array(coefs: Mapping[str, float], means: Mapping[str, float]):
    """(variavel, shap, valor) of every variable of a row, not rounded."""
    return F.array(*[
        F.struct(F.lit(c).alias("variavel"),
                 (F.lit(float(coefs[c])) * (F.col(f"`{c}`").cast("double") - F.lit(means[c]))).alias("shap"),
                 F.col(f"`{c}`").cast("double").alias("valor"))
        for c in coefs])


def _rounded(base: float):
    return [fixed("shap", 4).alias("shap"), fixed("valor", 3).alias("valor"), fixed(F.lit(base), 4).alias("base")]


def attribution_linear(x: DataFrame, coefs: Mapping[str, float], intercept: float,
                       key: str = "CustomerID", rounded: bool = True) -> DataFrame:
    """X1(a): contribution coef_i * (x_i - mean_i) of each variable to each row's
    log-odds; ``base`` + sum of contributions = the linear score.  Rounded last;
    ``rounded=False`` keeps the values for further aggregation."""
    means, base = linear_base(x, coefs, intercept)
    # outer: the array is never empty, and Catalyst would else push a filter on its whole expression down
    long = x.select(key, F.explode_outer(_contrib_array(coefs, means)).alias("c")).select(key, "c.*")
    return long.select(key, "variavel", *(_rounded(base) if rounded else ["shap", "valor", F.lit(base).alias("base")]))


def top_factors_in_row(x: DataFrame, coefs: Mapping[str, float], intercept: float,
                       k: int = TOP_FACTORS, key: str = "CustomerID", fit_on: DataFrame | None = None) -> DataFrame:
    """X1 + X3 fused: the k largest |contributions| of each row, sorted inside the
    row and rounded last.  ``fit_on`` are the rows whose means are the base (``x``
    itself by default), so that ``x`` may be a selection.  ``maior`` is the row's
    largest rounded |contribution|."""
    means, base = linear_base(x if fit_on is None else fit_on, coefs, intercept)
    arr = F.transform(_contrib_array(coefs, means),
                      lambda s: F.struct((-F.abs(s["shap"])).alias("k"), s["variavel"].alias("variavel"),
                                         s["shap"].alias("shap"), s["valor"].alias("valor")))
    top = x.select(key, F.slice(F.sort_array(arr), 1, k).alias("top"))
    return (top.select(key, fixed(F.abs(F.col("top")[0]["shap"]), 4).alias("maior"), F.posexplode_outer("top").alias("pos", "c"))
               .select(key, (F.col("pos") + 1).cast("int").alias("ordem"), "c.variavel", F.col("c.shap").alias("shap"),
                       F.col("c.valor").alias("valor"), "maior")
               .select(key, "ordem", "variavel", *_rounded(base), "maior"))


def factor_documents(x: DataFrame, coefs: Mapping[str, float], intercept: float, k: int = TOP_FACTORS,
                     key: str = "CustomerID", fit_on: DataFrame | None = None) -> DataFrame:
    """S8 form of X1 + X3 + X4: (key, base, fatores), the k largest factors of each row with
    their labels as one array.  Everything happens inside the row: nothing is exploded or grouped."""
    means, base = linear_base(x if fit_on is None else fit_on, coefs, intercept)
    arr = F.transform(_contrib_array(coefs, means), lambda s: F.struct(
        (-F.abs(s["shap"])).alias("k"), s["variavel"].alias("variavel"), s["shap"].alias("shap"), s["valor"].alias("valor")))
    best = x.select(key, F.slice(F.sort_array(arr), 1, k).alias("top"))
    factor = F.transform("top", lambda s, i: F.struct(
        (i + 1).cast("int").alias("ordem"), s["variavel"].alias("variavel"), label_of(s["variavel"]).alias("rotulo"),
        fixed(s["shap"], 4).alias("shap"), fixed(s["valor"], 3).alias("valor")))
    return best.select(key, fixed(F.lit(base), 4).alias("base"), factor.alias("fatores"))


def attribution_top(long: DataFrame, k: int = TOP_FACTORS, key: str = "CustomerID") -> DataFrame:
    """X3 for a long attribution table: k largest |shap| per customer, ties by name."""
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("shap")), F.asc("variavel"))
    return (long.select("*", F.row_number().over(w).cast("int").alias("ordem"))
                .where(F.col("ordem") <= k))


def attribution_global(long: DataFrame, k: int = TOP_GLOBAL) -> DataFrame:
    """Mean |contribution| per variable (of values not rounded), the k largest, with labels."""
    return largest_global(long.groupBy("variavel").agg(F.avg(F.abs("shap")).alias("impacto")), k)


def largest_global(impacts: DataFrame, k: int = TOP_GLOBAL) -> DataFrame:
    """The ``k`` largest of (variavel, impacto), ties by name, with labels."""
    g = impacts.select("variavel", "impacto").orderBy(F.desc("impacto"), "variavel").limit(k)
    return with_labels(g).select("variavel", "rotulo", fixed("impacto", 4).alias("impacto_medio"))


def global_scale(global_factors: DataFrame, first: int = 10) -> DataFrame:
    """Each of the first global factors as a share of the largest one
    (the global table is at most ``TOP_GLOBAL`` rows)."""
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("impacto_medio"), F.asc("variavel"))
    ranked = global_factors.select("*", F.row_number().over(w).alias("_pos")).where(F.col("_pos") <= first)
    top = F.max("impacto_medio").over(Window.partitionBy())
    return ranked.select("variavel", "rotulo", "impacto_medio",
                         fixed(F.col("impacto_medio") / top, 4).alias("escala")).drop("_pos")
