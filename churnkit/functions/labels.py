"""Readable factor labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label dictionary and one-hot prefixes of the reference.
LABELS = {
    "CurrentEquipmentDays": "Dias com o aparelho atual",
    "IdadeAparelhoMeses": "Idade do aparelho (meses)",
    "MonthsInService": "Meses de contrato",
    "MonthlyMinutes": "Minutos mensais",
    "MonthlyRevenue": "Receita mensal",
    "TotalRecurringCharge": "Mensalidade recorrente",
    "PercChangeMinutes": "Variacao de minutos (%)",
    "PercChangeRevenues": "Variacao de receita (%)",
    "OverageMinutes": "Minutos excedentes",
    "RazaoOverage": "Proporcao de minutos excedentes",
    "ReceitaPorMinuto": "Receita por minuto (preco pago)",
    "ReceitaPorMes": "Receita media por mes de contrato",
    "DroppedCalls": "Chamadas caidas",
    "BlockedCalls": "Chamadas bloqueadas",
    "DroppedBlockedCalls": "Chamadas caidas + bloqueadas",
    "FalhasPorChamada": "Falhas por chamada (qualidade)",
    "NaoAtendidasPorChamada": "Nao atendidas por chamada",
    "UnansweredCalls": "Chamadas nao atendidas",
    "CustomerCareCalls": "Ligacoes ao atendimento",
    "CareCallsPorMes": "Ligacoes ao atendimento por mes",
    "RetentionCalls": "Ligacoes a equipe de retencao",
    "RetentionPorMes": "Ligacoes a retencao por mes",
    "MadeCallToRetentionTeam": "Ja ligou para a retencao",
    "RetentionOffersAccepted": "Ofertas de retencao aceitas",
    "HandsetPrice": "Preco do aparelho",
    "HandsetPriceKnown": "Preco do aparelho informado",
    "HandsetRefurbished": "Aparelho recondicionado",
    "HandsetWebCapable": "Aparelho com internet",
    "Handsets": "Qtde de aparelhos",
    "HandsetModels": "Qtde de modelos de aparelho",
    "RazaoAparelhoContrato": "Idade do aparelho vs contrato",
    "FimFidelizacao": "Fim do periodo de fidelizacao (11-16m)",
    "QuedaUso": "Queda recente de uso",
    "RazaoSubsAtivos": "Proporcao de linhas ativas",
    "UniqueSubs": "Linhas na conta",
    "ActiveSubs": "Linhas ativas",
    "ReceivedCalls": "Chamadas recebidas",
    "OutboundCalls": "Chamadas realizadas",
    "InboundCalls": "Chamadas de entrada",
    "PeakCallsInOut": "Chamadas em horario de pico",
    "OffPeakCallsInOut": "Chamadas fora de pico",
    "CallWaitingCalls": "Chamadas em espera",
    "ThreewayCalls": "Chamadas em conferencia",
    "DirectorAssistedCalls": "Chamadas com auxilio de telefonista",
    "RoamingCalls": "Chamadas em roaming",
    "CallForwardingCalls": "Chamadas encaminhadas",
    "CreditRating": "Nota de credito (1=melhor)",
    "AdjustmentsToCreditRating": "Ajustes na nota de credito",
    "IncomeGroup": "Faixa de renda",
    "AgeHH1": "Idade do titular",
    "AgeHH2": "Idade do 2o morador",
    "AgeHH1Known": "Idade do titular informada",
    "AgeHH2Known": "Idade do 2o morador informada",
    "ChildrenInHH": "Criancas em casa",
    "HomeownershipKnown": "Imovel proprio informado",
    "MissingBillingInfo": "Sem dados de fatura",
    "ServiceAreaFreq": "Porte da area de servico",
    "NewCellphoneUser": "Usuario novo de celular",
    "NotNewCellphoneUser": "Usuario experiente de celular",
    "BuysViaMailOrder": "Compra por catalogo",
    "RespondsToMailOffers": "Responde a ofertas por correio",
    "OptOutMailings": "Recusou mala direta",
    "OwnsComputer": "Tem computador",
    "HasCreditCard": "Tem cartao de credito",
    "ReferralsMadeBySubscriber": "Indicacoes feitas",
}
ONEHOT_PREFIXES = ("MaritalStatus_", "PrizmCode_", "Occupation_")


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELS.items()), "variavel string, rotulo_dic string")


def prefix_label(c: Column) -> Column:
    """'Prefix_level' -> 'Prefix: level' (text after the first '_') for the
    one-hot prefixes, else null."""
    rest = F.regexp_extract(c, r"^[^_]*_(.*)$", 1)
    out = F.lit(None).cast("string")
    for p in reversed(ONEHOT_PREFIXES):
        out = F.when(c.startswith(p), F.concat(F.lit(p[:-1] + ": "), rest)).otherwise(out)
    return out


def with_labels(df: DataFrame, col: str = "variavel") -> DataFrame:
    """Dictionary label, else the one-hot prefix rule, else the name itself.

    The dictionary is a fixed table of under a hundred rows: broadcast.
    """
    tab = F.broadcast(label_table(df.sparkSession).withColumnRenamed("variavel", col))
    return (df.join(tab, col, "left")
              .withColumn("rotulo", F.coalesce(F.col("rotulo_dic"), prefix_label(F.col(col)), F.col(col)))
              .drop("rotulo_dic"))


def label_of(c: Column) -> Column:
    """X4 as an expression, for variables inside an array (the dictionary as a literal map)."""
    words = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, c), prefix_label(c), c)
