"""The dashboard bundle as tables (one parquet folder per member).

The reference inlines everything (scores included) into one generated file;
here each member is a table written by Spark, and the scores stay a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit.operators import curves as cv
from churnkit.operators import explain as ex
from churnkit.operators import policy as pol
from churnkit.operators import serving as sv
from churnkit.operators.segments import SEGMENTS, segment_sizes
from churnkit.plans.context import Chain
from churnkit.sources import io as sio


def members(c: Chain, importances: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every member; the model's importances where a fitted model gives them."""
    spark = c.spark
    sc = cv.score_counts(c.scores)
    long = ex.attribution_linear(c.features, ex.FIXTURE_COEFS, ex.FIXTURE_INTERCEPT, rounded=False)
    return {
        "meta": cv.bundle_meta(c.scores, sc),
        "scores": c.ranking,
        "roc": cv.roc_reduced(sc),
        "distribuicao": cv.score_histogram(sc),
        "ranking": sv.ranking_preview(c.top(sv.PREVIEW_ROWS)),
        "shap_global": ex.attribution_global(long),
        "acoes": pol.action_dim(spark),
        "segmentos": spark.createDataFrame([(k, s) for k, s in enumerate(SEGMENTS, 1)], "posicao int, segmento string"),
        "distribuicao_segmentos": segment_sizes(c.segments),
        "politica": c.order,
        "melhor_acao": c.best,
        "rodadas": c.offer_events.agg(F.count(F.lit(1)).alias("rodadas")),
        "curva": pol.learning_curve(c.offers, c.counts),
        "clientes_detalhe": sv.client_detail_nested(c.detail),
        **({} if importances is None else {"importancias": importances}),
    }


def value_sum(df: DataFrame) -> F.Column:
    """All numbers of a member as one: every numeric column to four decimals, summed as integers (text, as it outgrows a long)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    each = [F.floor(F.coalesce(F.col(f"`{x}`").cast("double"), F.lit(0.0)) * F.lit(10000.0) + F.lit(0.5)).cast("long") for x in cols]
    return F.coalesce(F.sum(sum(each[1:], each[0]).cast("decimal(38,0)")), F.lit(0)).cast("string")


def export_bundle(c: Chain, out_dir: str, importances: DataFrame | None = None) -> DataFrame:
    """Write every member under ``out_dir``; return the manifest (membro, linhas, soma) of what was read back."""
    spark = c.spark
    rows = []
    for name, df in members(c, importances).items():
        back = spark.read.parquet(sio.write_parquet(df, f"{out_dir.rstrip('/')}/{name}"))
        r = back.agg(F.count(F.lit(1)).alias("n"), value_sum(back).alias("s")).first()
        rows.append((name, r["n"], r["s"]))
    return spark.createDataFrame(rows, "membro string, linhas long, soma string")
