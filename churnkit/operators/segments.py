"""Rule segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit.functions.quantiles import quantiles

# Segment names in priority order and the rule cut-offs.
SEG_UNHAPPY = "Insatisfeito com o servico"
SEG_PRICE = "Sensivel a preco"
SEG_DEVICE = "Aparelho desatualizado"
SEG_LOYALTY = "Fim de fidelizacao"
SEG_GENERAL = "Perfil geral"
SEGMENTS = [SEG_UNHAPPY, SEG_PRICE, SEG_DEVICE, SEG_LOYALTY, SEG_GENERAL]
CUT_QUANTILE = 0.75
DEVICE_MONTHS = 12.0
CUT_COLUMNS = {"falhas_q75": "FalhasPorChamada", "care_q75": "CareCallsPorMes",
               "overage_q75": "RazaoOverage", "preco_min_q75": "ReceitaPorMinuto"}


def fit_cuts(features: DataFrame, method: str = "exact") -> dict[str, float]:
    """0.75 quantile (linear) of four features, plus the device-age cut."""
    q = quantiles(features, {c: [CUT_QUANTILE] for c in CUT_COLUMNS.values()}, method=method)
    cuts = {name: q[c][0] for name, c in CUT_COLUMNS.items()}
    cuts["aparelho_meses"] = DEVICE_MONTHS
    return cuts


def cuts_frame(spark: SparkSession, cuts: dict[str, float]) -> DataFrame:
    names = list(CUT_COLUMNS) + ["aparelho_meses"]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    return spark.createDataFrame([tuple(float(cuts[n]) for n in names)], schema)


def segment_column(cuts: dict[str, float]):
    c = F.col
    unhappy = ((c("FalhasPorChamada") >= F.lit(cuts["falhas_q75"]))
               | (c("CareCallsPorMes") >= F.lit(cuts["care_q75"])))
    price = ((c("RazaoOverage") >= F.lit(cuts["overage_q75"]))
             | (c("ReceitaPorMinuto") >= F.lit(cuts["preco_min_q75"])))
    device = c("IdadeAparelhoMeses") >= F.lit(cuts["aparelho_meses"])
    loyalty = c("FimFidelizacao") == 1
    return (F.when(unhappy, SEG_UNHAPPY).when(price, SEG_PRICE).when(device, SEG_DEVICE)
             .when(loyalty, SEG_LOYALTY).otherwise(SEG_GENERAL))


def segment_assign(features: DataFrame, cuts: dict[str, float] | None = None,
                   key: str = "CustomerID", fit_on: DataFrame | None = None) -> DataFrame:
    """R2: first matching rule wins; cuts fitted on ``fit_on`` (default: the rows themselves)."""
    if cuts is None:
        cuts = fit_cuts(fit_on if fit_on is not None else features)
    return features.select(key, segment_column(cuts).alias("segmento"))


def segment_sizes(segments: DataFrame) -> DataFrame:
    """Customers per segment, largest first."""
    return (segments.groupBy("segmento").agg(F.count(F.lit(1)).alias("clientes"))
                    .orderBy(F.desc("clientes"), "segmento"))
