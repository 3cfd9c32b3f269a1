"""Profiling operators P1-P14.

Each concern is one aggregate pass over the table with one expression per
column, reshaped afterwards with ``stack`` (the reshaped table has one row
per column, not per input row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit.functions.columns import fixed
from churnkit.functions.quantiles import quantiles

# Fixed values of the reference profile.
DISGUISED_TOKENS = ("unknown", "known", "na", "n/a", "none", "?", "")
NEGATIVE_ALLOWED = ("PercChangeMinutes", "PercChangeRevenues")
DOMAIN_MAX_LEVELS = 12
TOP_VALUES = 15
QUARTILE_EDGES = (0.0, 0.25, 0.5, 0.75, 1.0)
RATE_COLUMNS = ("MonthsInService", "MonthlyRevenue", "CurrentEquipmentDays", "RetentionCalls")


def _string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _stack(row_df: DataFrame, items: Sequence[tuple[str, ...]], names: Sequence[str]) -> DataFrame:
    """Reshape a one-row aggregate: each item is a tuple of SQL expressions."""
    body = ", ".join(", ".join(it) for it in items)
    return row_df.selectExpr(f"stack({len(items)}, {body}) AS ({', '.join(names)})")


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def profile_shape(df: DataFrame) -> DataFrame:
    """Rows, columns and columns per data type (types from the schema)."""
    types: dict[str, int] = {}
    for f in df.schema.fields:
        types[f.dataType.simpleString()] = types.get(f.dataType.simpleString(), 0) + 1
    n = df.agg(F.count(F.lit(1)).alias("n"))
    items = [("'linhas'", "n"), ("'colunas'", f"CAST({len(df.columns)} AS BIGINT)")]
    items += [(_lit(f"tipo_{t}"), f"CAST({k} AS BIGINT)") for t, k in sorted(types.items())]
    return _stack(n, items, ["metrica", "valor"])


def profile_target(df: DataFrame, target: str = "Churn") -> DataFrame:
    """Count and share per target value, nulls kept."""
    total = df.count()
    return (df.groupBy(target).agg(F.count(F.lit(1)).alias("contagem"))
              .select(target, "contagem",
                      fixed(F.col("contagem") / F.lit(float(total)), 4).alias("proporcao")))


def profile_nulls(df: DataFrame) -> DataFrame:
    """Null count and percent per column, only columns with nulls, largest first."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    long = _stack(row, [(_lit(c), f"c{i}", "_n") for i, c in enumerate(cols)],
                  ["coluna", "qtd_nan", "_n"])
    return (long.where(F.col("qtd_nan") > 0)
                .select("coluna", "qtd_nan",
                        fixed(F.col("qtd_nan") / F.col("_n") * F.lit(100.0), 2).alias("pct"))
                .orderBy(F.desc("qtd_nan"), "coluna"))


def profile_disguised(df: DataFrame, tokens: Sequence[str] = DISGUISED_TOKENS) -> DataFrame:
    """P5: trimmed, lower-cased string values that stand for 'missing', counted."""
    cols = _string_cols(df)
    aggs, items = [], []
    for i, c in enumerate(cols):
        v = F.lower(F.trim(F.col(c)))
        for j, t in enumerate(tokens):
            aggs.append(F.count_if(v == F.lit(t)).alias(f"c{i}_{j}"))
            items.append((_lit(c), _lit(t), f"c{i}_{j}"))
    if not aggs:
        return df.sparkSession.createDataFrame([], "coluna string, valor string, contagem bigint")
    return _stack(df.agg(*aggs), items, ["coluna", "valor", "contagem"]).where(F.col("contagem") > 0)


def profile_sentinel_share(df: DataFrame, sentinels: Sequence[tuple[str, object]]) -> DataFrame:
    """Share of rows equal to a sentinel, per (column, sentinel)."""
    present = [(c, s) for c, s in sentinels if c in df.columns]
    row = df.agg(*[F.avg(F.coalesce((F.col(c) == F.lit(s)).cast("double"), F.lit(0.0))).alias(f"s{i}")
                   for i, (c, s) in enumerate(present)])
    return _stack(row, [(_lit(c), _lit(str(s)), f"s{i}") for i, (c, s) in enumerate(present)],
                  ["coluna", "sentinela", "proporcao"]).select(
        "coluna", "sentinela", fixed("proporcao", 6).alias("proporcao"))


def profile_cardinality(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-null values per string column, largest first."""
    cols = _string_cols(df)
    fn = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    row = df.agg(*[fn(c).alias(f"c{i}") for i, c in enumerate(cols)])
    return (_stack(row, [(_lit(c), f"CAST(c{i} AS BIGINT)") for i, c in enumerate(cols)],
                   ["coluna", "distintos"]).orderBy(F.desc("distintos"), "coluna"))


def profile_domains(df: DataFrame, max_levels: int = DOMAIN_MAX_LEVELS) -> DataFrame:
    """Sorted values of string columns with at most ``max_levels`` values.

    Columns are chosen from the distinct counts of P7 first, so every
    collected set holds at most ``max_levels`` values.
    """
    cols = _string_cols(df)
    card = {r["coluna"]: r["distintos"] for r in profile_cardinality(df).collect()}
    small = [c for c in cols if card[c] <= max_levels]
    if not small:
        return df.sparkSession.createDataFrame([], "coluna string, valor string, posicao int")
    row = df.agg(*[F.array_sort(F.collect_set(c)).alias(f"d{i}") for i, c in enumerate(small)])

    def numbered(column: str):
        return lambda v, k: F.struct(F.lit(column).alias("coluna"), v.alias("valor"), (k + 1).cast("int").alias("posicao"))

    each = [F.transform(f"d{i}", numbered(c)) for i, c in enumerate(small)]
    return row.select(F.explode(F.flatten(F.array(*each))).alias("d")).select("d.coluna", "d.valor", "d.posicao")


def profile_describe(df: DataFrame, method: str = "exact") -> DataFrame:
    """Count, mean, sample std, min, quartiles, max of each numeric column."""
    cols = _numeric_cols(df)
    q = quantiles(df.select(*[F.col(c).cast("double").alias(c) for c in cols]),
                  {c: [0.25, 0.5, 0.75] for c in cols}, method=method)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs)
    items = []
    for i, c in enumerate(cols):
        qs = [("CAST(NULL AS DOUBLE)" if v is None else f"CAST({float(v)!r} AS DOUBLE)") for v in q[c]]
        items.append((_lit(c), f"n{i}", f"m{i}", f"s{i}", f"lo{i}", *qs, f"hi{i}"))
    return _stack(row, items, ["coluna", "count", "mean", "std", "min", "q25", "q50", "q75", "max"])


def profile_dup_keys(df: DataFrame, key: str = "CustomerID") -> DataFrame:
    """P10: key occurrences beyond the first."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
              .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicados")))


def profile_dup_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicates beyond the first (nulls compare equal)."""
    return (df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
              .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicados")))


def profile_negatives(df: DataFrame, allowed: Sequence[str] = NEGATIVE_ALLOWED) -> DataFrame:
    """Negative values per numeric column, allow-listed columns skipped."""
    cols = [c for c in _numeric_cols(df) if c not in allowed]
    row = df.agg(*[F.count_if(F.col(c) < 0).alias(f"c{i}") for i, c in enumerate(cols)])
    return _stack(row, [(_lit(c), f"c{i}") for i, c in enumerate(cols)],
                  ["coluna", "negativos"]).where(F.col("negativos") > 0)


def profile_top_values(df: DataFrame, column: str = "HandsetPrice", k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values (nulls counted), ties by value."""
    return (df.groupBy(F.col(column).alias("valor")).agg(F.count(F.lit(1)).alias("contagem"))
              .orderBy(F.desc("contagem"), F.asc_nulls_first("valor")).limit(k))


def profile_rate_by_quartile(df: DataFrame, target: str = "Churn", positive: str = "Yes",
                             columns: Sequence[str] = RATE_COLUMNS, method: str = "exact") -> DataFrame:
    """Target rate and count per quartile bin (right-closed, equal edges merged).

    bin = max(1, number of distinct edges strictly below x); the minimum is in bin 1.
    """
    cols = [c for c in columns if c in df.columns]
    x = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in cols}
    num = df.select(*[x[c].alias(c) for c in cols],
                    F.col(target).eqNullSafe(F.lit(positive)).cast("double").alias("_y"))
    q = quantiles(num, {c: list(QUARTILE_EDGES) for c in cols}, method=method)
    cols = [c for c in cols if q[c][0] is not None]
    edges = {c: sorted(set(q[c])) for c in cols}
    bins = []
    for c in cols:
        below = sum(((F.col(c) > F.lit(e)).cast("int") for e in edges[c]), F.lit(0))
        bins.append(F.struct(F.lit(c).alias("coluna"),
                             F.when(F.col(c).isNotNull(), F.greatest(F.lit(1), below)).alias("faixa")))
    # one pass: each row yields one (column, bin) pair per column, aggregated map-side
    long = num.select(F.explode(F.array(*bins)).alias("b"), "_y").select("b.coluna", "b.faixa", "_y")
    agg = (long.where(F.col("faixa").isNotNull()).groupBy("coluna", "faixa")
               .agg(F.avg("_y").alias("taxa"), F.count(F.lit(1)).alias("contagem")))
    edge_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.array(*[F.lit(e) for e in edges[c]]))])
    arr = edge_map[F.col("coluna")]
    return agg.select("coluna", F.col("faixa").cast("int").alias("faixa"),
                      F.element_at(arr, F.col("faixa")).alias("limite_inf"),
                      F.element_at(arr, F.least(F.col("faixa") + 1, F.size(arr))).alias("limite_sup"),
                      fixed("taxa", 3).alias("taxa"), "contagem")
