"""Derived ratio features F1-F12: one stateless ``select``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.columns import clip_low

DERIVED = ("ReceitaPorMinuto", "RazaoOverage", "ReceitaPorMes", "FalhasPorChamada",
           "NaoAtendidasPorChamada", "CareCallsPorMes", "RetentionPorMes",
           "IdadeAparelhoMeses", "RazaoAparelhoContrato", "FimFidelizacao",
           "RazaoSubsAtivos", "QuedaUso")
# Contract-end window in months and days per month.
LOYALTY_END = (11, 16)
DAYS_PER_MONTH = 30.0


def feature_columns(df: DataFrame) -> dict:
    c = F.col
    minutos = clip_low("MonthlyMinutes", 1)
    meses = clip_low("MonthsInService", 1)
    chamadas = clip_low(c("OutboundCalls") + c("InboundCalls") + c("ReceivedCalls"), 1)
    idade = c("CurrentEquipmentDays") / F.lit(DAYS_PER_MONTH)
    pcm = c("PercChangeMinutes")
    return {
        "ReceitaPorMinuto": c("MonthlyRevenue") / minutos,
        "RazaoOverage": c("OverageMinutes") / minutos,
        "ReceitaPorMes": c("MonthlyRevenue") / meses,
        "FalhasPorChamada": c("DroppedBlockedCalls") / chamadas,
        "NaoAtendidasPorChamada": c("UnansweredCalls") / chamadas,
        "CareCallsPorMes": c("CustomerCareCalls") / meses,
        "RetentionPorMes": c("RetentionCalls") / meses,
        "IdadeAparelhoMeses": idade,
        "RazaoAparelhoContrato": idade / meses,
        "FimFidelizacao": c("MonthsInService").between(*LOYALTY_END).cast("int"),
        "RazaoSubsAtivos": c("ActiveSubs") / clip_low("UniqueSubs", 1),
        "QuedaUso": (F.when(pcm < 0, F.abs(pcm)).when(pcm.isNull(), F.lit(None))
                      .otherwise(F.lit(0.0))).cast("double"),
    }


def derive_features(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Append the 12 derived columns (optionally dropping e.g. the target)."""
    exprs = feature_columns(df)
    keep = [c for c in df.columns if c not in drop]
    return df.select(*keep, *[e.cast("double" if k != "FimFidelizacao" else "int").alias(k)
                              for k, e in exprs.items()])
