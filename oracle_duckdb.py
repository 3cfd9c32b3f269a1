"""DuckDB oracle SQL for every hash-checked query in ``__spark_entry__``.

Written independently of the Spark operators, as plain SQL over the
driver's pre-registered views.  Shared pieces are CTE strings that later
queries compose (``WITH`` + name list).  Doubles that come from sums or
averages are rounded with floor(x * 10^d + 0.5) / 10^d on both sides.
"""

from __future__ import annotations


def R(x: str, d: int = 6) -> str:
    """Portable half-up rounding to d places, as a DOUBLE."""
    return f"CAST(floor(({x}) * {10 ** d}.0 + 0.5) / {10 ** d}.0 AS DOUBLE)"


# ---------------------------------------------------------------- adapter
SUB_RAW = """
pre AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
         date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') AS days
  FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-06'
),
po AS (
  SELECT o_custkey,
    avg(o_totalprice) AS avg_price, max(o_totalprice) AS max_price,
    count(*) AS n_orders,
    count_if(o_orderstatus = 'O') AS n_o, count_if(o_orderstatus = 'F') AS n_f,
    count_if(o_orderstatus = 'P') AS n_p,
    count_if(o_orderpriority = '1-URGENT') AS n_urgent,
    count(DISTINCT o_orderpriority) AS uniq,
    count(DISTINCT CASE WHEN days <= 1095 THEN o_orderpriority END) AS active,
    min(days) AS min_days,
    arg_max(o_orderpriority, o_orderkey) AS credit,
    sum(CASE WHEN days <= 365 THEN o_totalprice / CAST(1000 AS DOUBLE) END) AS rev_recent,
    sum(CASE WHEN days > 365 AND days <= 730 THEN o_totalprice / CAST(1000 AS DOUBLE) END) AS rev_prior
  FROM pre GROUP BY o_custkey
),
pl AS (
  SELECT p.o_custkey AS pl_key, sum(l.l_quantity) AS minutes,
    sum(CASE WHEN l.l_quantity > 40 THEN l.l_quantity - CAST(40 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS overage,
    count_if(l.l_linestatus = 'O') AS n_lo,
    count_if(l.l_returnflag = 'R') AS n_r,
    sum(CASE WHEN p.days <= 365 THEN l.l_quantity END) AS q_recent,
    sum(CASE WHEN p.days > 365 AND p.days <= 730 THEN l.l_quantity END) AS q_prior
  FROM lineitem l JOIN pre p ON l.l_orderkey = p.o_orderkey GROUP BY p.o_custkey
),
post AS (SELECT DISTINCT o_custkey AS post_key FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-06'),
ev AS (
  SELECT user_id, count_if(event_type = 'error') AS n_error, count_if(event_type = 'view') AS n_view
  FROM events GROUP BY user_id
),
sub_raw AS (
  SELECT
    c.c_custkey AS CustomerID,
    CASE WHEN post.post_key IS NULL THEN 'Yes' ELSE 'No' END AS Churn,
    po.avg_price / CAST(1000 AS DOUBLE) AS MonthlyRevenue,
    pl.minutes AS MonthlyMinutes,
    po.max_price / CAST(1000 AS DOUBLE) AS TotalRecurringCharge,
    CAST(pl.n_lo AS DOUBLE) AS DirectorAssistedCalls,
    pl.overage AS OverageMinutes,
    CAST(po.n_p AS DOUBLE) AS RoamingCalls,
    pl.q_recent - pl.q_prior AS PercChangeMinutes,
    po.rev_recent - po.rev_prior AS PercChangeRevenues,
    CAST(coalesce(pl.n_r, 0) + coalesce(ev.n_error, 0) AS DOUBLE) AS DroppedBlockedCalls,
    CAST(coalesce(ev.n_view, 0) AS DOUBLE) AS UnansweredCalls,
    CAST(coalesce(pl.n_r, 0) AS DOUBLE) AS CustomerCareCalls,
    CAST(coalesce(po.n_p, 0) AS DOUBLE) AS ReceivedCalls,
    CAST(coalesce(po.n_o, 0) AS DOUBLE) AS OutboundCalls,
    CAST(coalesce(po.n_f, 0) AS DOUBLE) AS InboundCalls,
    CAST(6 + c.c_custkey % 56 AS BIGINT) AS MonthsInService,
    CAST(coalesce(po.uniq, 1) AS BIGINT) AS UniqueSubs,
    CAST(coalesce(po.active, 0) AS BIGINT) AS ActiveSubs,
    CAST(po.n_orders AS DOUBLE) AS Handsets,
    CAST(po.min_days AS DOUBLE) AS CurrentEquipmentDays,
    CAST(coalesce(po.n_urgent, 0) AS BIGINT) AS RetentionCalls,
    CASE WHEN c.c_custkey % 50 = 0 THEN CAST(NULL AS DOUBLE)
         WHEN c.c_custkey % 4 = 0 THEN CAST(0 AS DOUBLE)
         ELSE CAST(18 + c.c_custkey % 70 AS DOUBLE) END AS AgeHH1,
    CASE WHEN c.c_custkey % 200 = 7 THEN CAST(NULL AS VARCHAR)
         ELSE n.n_name || '-' || c.c_mktsegment END AS ServiceArea,
    CASE WHEN coalesce(po.credit, '4-NOT SPECIFIED') = '4-NOT SPECIFIED' THEN 'Unknown'
         ELSE CAST(10 * (1 + coalesce(po.n_orders, 0) % 10) AS VARCHAR) END AS HandsetPrice,
    coalesce(po.credit, '4-NOT SPECIFIED') AS CreditRating,
    r.r_name AS PrizmCode,
    c.c_mktsegment AS Occupation,
    CASE WHEN c.c_custkey % 5 <= 1 THEN 'Unknown' WHEN c.c_custkey % 5 <= 3 THEN 'Yes' ELSE 'No' END AS MaritalStatus,
    CASE WHEN c.c_acctbal > 3000 THEN 'Known' ELSE 'Unknown' END AS Homeownership,
    CASE WHEN coalesce(po.n_urgent, 0) > 2 THEN 'Yes' ELSE 'No' END AS MadeCallToRetentionTeam
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN po ON c.c_custkey = po.o_custkey
  LEFT JOIN pl ON c.c_custkey = pl.pl_key
  LEFT JOIN post ON c.c_custkey = post.post_key
  LEFT JOIN ev ON c.c_custkey = ev.user_id
)"""

# ------------------------------------------------------------- treatment
MEDIAN_EXPR = {
    "HandsetPrice": "TRY_CAST(HandsetPrice AS DOUBLE)",
    "AgeHH1": "CASE WHEN AgeHH1 <> 0 THEN AgeHH1 END",
    "CurrentEquipmentDays": "CASE WHEN CurrentEquipmentDays >= 0 THEN CurrentEquipmentDays END",
    "MonthlyRevenue": "MonthlyRevenue", "MonthlyMinutes": "MonthlyMinutes",
    "TotalRecurringCharge": "TotalRecurringCharge",
    "DirectorAssistedCalls": "DirectorAssistedCalls", "OverageMinutes": "OverageMinutes",
    "RoamingCalls": "RoamingCalls", "PercChangeMinutes": "PercChangeMinutes",
    "PercChangeRevenues": "PercChangeRevenues", "Handsets": "Handsets",
}
BILLING = ["MonthlyRevenue", "MonthlyMinutes", "TotalRecurringCharge",
           "DirectorAssistedCalls", "OverageMinutes", "RoamingCalls"]
RESIDUAL = ["PercChangeMinutes", "PercChangeRevenues", "Handsets"]
LEVELS = {
    "MaritalStatus": ["No", "Unknown", "Yes"],
    "PrizmCode": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    "Occupation": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}
CREDIT = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


def _dummies(col: str, src: str = "r") -> list[str]:
    return [f'CAST(CASE WHEN {src}.{col} = \'{lv}\' THEN 1 ELSE 0 END AS INTEGER) AS "{col}_{lv}"'
            for lv in LEVELS[col]]


def _median_cte(name: str, src: str) -> str:
    return (f"{name} AS (SELECT "
            + ", ".join(f"quantile_cont({e}, 0.5) AS {c}" for c, e in MEDIAN_EXPR.items())
            + f" FROM {src})")


def _area_cte(name: str, src: str) -> str:
    return (f"{name} AS (SELECT coalesce(ServiceArea, 'DESCONHECIDA') AS area, "
            f"count(*) / CAST((SELECT count(*) FROM {src}) AS DOUBLE) AS freq "
            f"FROM {src} GROUP BY 1)")


def _treated_cte(name: str, src: str, med: str, area: str) -> str:
    credit = " ".join(f"WHEN '{k}' THEN {v}" for k, v in CREDIT.items())
    cols = [
        "r.CustomerID",
        "CAST(CASE WHEN r.Churn = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS Churn",
        *[f"coalesce(r.{c}, m.{c}) AS {c}" for c in BILLING[:6]],
        *[f"coalesce(r.{c}, m.{c}) AS {c}" for c in ["PercChangeMinutes", "PercChangeRevenues"]],
        "r.DroppedBlockedCalls", "r.UnansweredCalls", "r.CustomerCareCalls", "r.ReceivedCalls",
        "r.OutboundCalls", "r.InboundCalls", "r.MonthsInService", "r.UniqueSubs", "r.ActiveSubs",
        "coalesce(r.Handsets, m.Handsets) AS Handsets",
        "coalesce(CASE WHEN r.CurrentEquipmentDays >= 0 THEN r.CurrentEquipmentDays END, "
        "m.CurrentEquipmentDays) AS CurrentEquipmentDays",
        "r.RetentionCalls",
        "coalesce(CASE WHEN r.AgeHH1 <> 0 THEN r.AgeHH1 END, m.AgeHH1) AS AgeHH1",
        "coalesce(TRY_CAST(r.HandsetPrice AS DOUBLE), m.HandsetPrice) AS HandsetPrice",
        f"CAST(CASE r.CreditRating {credit} END AS INTEGER) AS CreditRating",
        "CAST(CASE WHEN r.MadeCallToRetentionTeam = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS MadeCallToRetentionTeam",
        "CAST(CASE WHEN r.Homeownership = 'Known' THEN 1 ELSE 0 END AS INTEGER) AS HomeownershipKnown",
        *_dummies("MaritalStatus"),
        "CAST(TRY_CAST(r.HandsetPrice AS DOUBLE) IS NOT NULL AS INTEGER) AS HandsetPriceKnown",
        "CAST((CASE WHEN r.AgeHH1 <> 0 THEN r.AgeHH1 END) IS NOT NULL AS INTEGER) AS AgeHH1Known",
        "CAST(" + " AND ".join(f"r.{c} IS NULL" for c in BILLING) + " AS INTEGER) AS MissingBillingInfo",
        *_dummies("PrizmCode"), *_dummies("Occupation"),
        "coalesce(a.freq, CAST(0 AS DOUBLE)) AS ServiceAreaFreq",
    ]
    return (f"{name} AS (SELECT " + ",\n    ".join(cols)
            + f" FROM {src} r CROSS JOIN {med} m LEFT JOIN {area} a "
              "ON coalesce(r.ServiceArea, 'DESCONHECIDA') = a.area)")


TREATED = ",\n".join([SUB_RAW, _median_cte("med", "sub_raw"), _area_cte("area", "sub_raw"),
                      _treated_cte("sub_treated", "sub_raw", "med", "area")])

FEATURE_EXPR = {
    "ReceitaPorMinuto": "MonthlyRevenue / greatest(MonthlyMinutes, 1)",
    "RazaoOverage": "OverageMinutes / greatest(MonthlyMinutes, 1)",
    "ReceitaPorMes": "MonthlyRevenue / greatest(MonthsInService, 1)",
    "FalhasPorChamada": "DroppedBlockedCalls / greatest(OutboundCalls + InboundCalls + ReceivedCalls, 1)",
    "NaoAtendidasPorChamada": "UnansweredCalls / greatest(OutboundCalls + InboundCalls + ReceivedCalls, 1)",
    "CareCallsPorMes": "CustomerCareCalls / greatest(MonthsInService, 1)",
    "RetentionPorMes": "RetentionCalls / greatest(MonthsInService, 1)",
    "IdadeAparelhoMeses": "CurrentEquipmentDays / CAST(30 AS DOUBLE)",
    "RazaoAparelhoContrato": "(CurrentEquipmentDays / CAST(30 AS DOUBLE)) / greatest(MonthsInService, 1)",
    "FimFidelizacao": "CAST(MonthsInService BETWEEN 11 AND 16 AS INTEGER)",
    "RazaoSubsAtivos": "ActiveSubs / greatest(UniqueSubs, 1)",
    "QuedaUso": "CASE WHEN PercChangeMinutes < 0 THEN abs(PercChangeMinutes) "
                "WHEN PercChangeMinutes IS NULL THEN NULL ELSE CAST(0 AS DOUBLE) END",
}
FEATURES = TREATED + ",\nsub_feat AS (SELECT * EXCLUDE (Churn), " + ", ".join(
    f"{e} AS {k}" for k, e in FEATURE_EXPR.items()) + " FROM sub_treated)"

SEGMENTED = FEATURES + """,
cuts AS (SELECT quantile_cont(FalhasPorChamada, 0.75) AS falhas_q75,
                quantile_cont(CareCallsPorMes, 0.75) AS care_q75,
                quantile_cont(RazaoOverage, 0.75) AS overage_q75,
                quantile_cont(ReceitaPorMinuto, 0.75) AS preco_min_q75,
                CAST(12 AS DOUBLE) AS aparelho_meses FROM sub_feat),
sub_seg AS (SELECT f.CustomerID,
  CASE WHEN f.FalhasPorChamada >= k.falhas_q75 OR f.CareCallsPorMes >= k.care_q75 THEN 'Insatisfeito com o servico'
       WHEN f.RazaoOverage >= k.overage_q75 OR f.ReceitaPorMinuto >= k.preco_min_q75 THEN 'Sensivel a preco'
       WHEN f.IdadeAparelhoMeses >= k.aparelho_meses THEN 'Aparelho desatualizado'
       WHEN f.FimFidelizacao = 1 THEN 'Fim de fidelizacao'
       ELSE 'Perfil geral' END AS segmento
  FROM sub_feat f CROSS JOIN cuts k)"""

RAW_DOUBLES = ["MonthlyRevenue", "MonthlyMinutes", "TotalRecurringCharge", "DirectorAssistedCalls",
               "OverageMinutes", "RoamingCalls", "PercChangeMinutes", "PercChangeRevenues",
               "DroppedBlockedCalls", "UnansweredCalls", "CustomerCareCalls", "ReceivedCalls",
               "OutboundCalls", "InboundCalls", "Handsets", "CurrentEquipmentDays", "AgeHH1"]
TREATED_DOUBLES = RAW_DOUBLES + ["HandsetPrice", "ServiceAreaFreq"]
FEATURE_DOUBLES = TREATED_DOUBLES + [k for k in FEATURE_EXPR if k != "FimFidelizacao"]


def rounded(body: str, doubles: list[str], d: int = 6) -> str:
    """``SELECT * REPLACE`` rounding of the named double columns."""
    rep = ", ".join(f"{R(c, d)} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({body})"


ORACLE: dict[str, str] = {}

ORACLE["scan_subscriber"] = f"WITH {SUB_RAW} " + rounded("SELECT * FROM sub_raw", RAW_DOUBLES)
ORACLE["clean_target"] = (f"WITH {SUB_RAW} SELECT CustomerID, "
                          "CAST(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS Churn FROM sub_raw")
ORACLE["clean_yes_no"] = (f"WITH {SUB_RAW} SELECT CustomerID, CAST(CASE WHEN MadeCallToRetentionTeam = 'Yes' "
                          "THEN 1 ELSE 0 END AS INTEGER) AS MadeCallToRetentionTeam FROM sub_raw")
ORACLE["clean_known_flag"] = (f"WITH {SUB_RAW} SELECT CustomerID, CAST(CASE WHEN Homeownership = 'Known' "
                              "THEN 1 ELSE 0 END AS INTEGER) AS HomeownershipKnown FROM sub_raw")
ORACLE["encode_onehot"] = (f"WITH {SUB_RAW} SELECT r.CustomerID, "
                           + ", ".join(_dummies("MaritalStatus") + _dummies("PrizmCode") + _dummies("Occupation"))
                           + " FROM sub_raw r")
ORACLE["clean_text_number"] = (
    f"WITH {TREATED} SELECT CustomerID, HandsetPrice, HandsetPriceKnown FROM sub_treated")
ORACLE["clean_zero_sentinel"] = f"WITH {TREATED} SELECT CustomerID, AgeHH1, AgeHH1Known FROM sub_treated"
ORACLE["clean_negative_sentinel"] = f"WITH {TREATED} SELECT CustomerID, CurrentEquipmentDays FROM sub_treated"
ORACLE["flag_all_null_block"] = f"WITH {TREATED} SELECT CustomerID, MissingBillingInfo FROM sub_treated"
ORACLE["impute_median"] = f"WITH {TREATED} " + rounded(
    "SELECT CustomerID, " + ", ".join(BILLING + RESIDUAL) + " FROM sub_treated", BILLING + RESIDUAL)
ORACLE["encode_ordinal"] = f"WITH {TREATED} SELECT CustomerID, CreditRating FROM sub_treated"
ORACLE["encode_frequency"] = f"WITH {TREATED} SELECT CustomerID, ServiceAreaFreq FROM sub_treated"
ORACLE["treat_all"] = f"WITH {TREATED} " + rounded("SELECT * FROM sub_treated", TREATED_DOUBLES)
ORACLE["fit_params"] = (
    f"WITH {TREATED} SELECT tipo, chave, {R('valor', 9)} AS valor FROM ("
    + " UNION ALL ".join(f"SELECT 'median' AS tipo, '{c}' AS chave, {c} AS valor FROM med"
                         for c in MEDIAN_EXPR)
    + " UNION ALL SELECT 'area_freq', area, freq FROM area)")
ORACLE["derive_features"] = f"WITH {FEATURES} " + rounded("SELECT * FROM sub_feat", FEATURE_DOUBLES)
ORACLE["segment_cuts"] = (f"WITH {SEGMENTED} SELECT " + ", ".join(
    f"{R(c, 9)} AS {c}" for c in ["falhas_q75", "care_q75", "overage_q75", "preco_min_q75", "aparelho_meses"])
    + " FROM cuts")
ORACLE["segment_assign"] = f"WITH {SEGMENTED} SELECT CustomerID, segmento FROM sub_seg"
ORACLE["segment_sizes"] = (f"WITH {SEGMENTED} SELECT segmento, count(*) AS clientes FROM sub_seg "
                           "GROUP BY segmento ORDER BY clientes DESC, segmento")

# --------------------------------------------------------------- profile
RAW_COLS = ["CustomerID", "Churn", "MonthlyRevenue", "MonthlyMinutes", "TotalRecurringCharge",
            "DirectorAssistedCalls", "OverageMinutes", "RoamingCalls", "PercChangeMinutes",
            "PercChangeRevenues", "DroppedBlockedCalls", "UnansweredCalls", "CustomerCareCalls",
            "ReceivedCalls", "OutboundCalls", "InboundCalls", "MonthsInService", "UniqueSubs",
            "ActiveSubs", "Handsets", "CurrentEquipmentDays", "RetentionCalls", "AgeHH1",
            "ServiceArea", "HandsetPrice", "CreditRating", "PrizmCode", "Occupation",
            "MaritalStatus", "Homeownership", "MadeCallToRetentionTeam"]
RAW_STRINGS = ["Churn", "ServiceArea", "HandsetPrice", "CreditRating", "PrizmCode", "Occupation",
               "MaritalStatus", "Homeownership", "MadeCallToRetentionTeam"]
RAW_LONGS = ["CustomerID", "MonthsInService", "UniqueSubs", "ActiveSubs", "RetentionCalls"]
RAW_NUMERIC = [c for c in RAW_COLS if c not in RAW_STRINGS]
TOKENS = ["unknown", "known", "na", "n/a", "none", "?", ""]

ORACLE["profile_shape"] = (
    f"WITH {SUB_RAW} SELECT * FROM (VALUES ('linhas', (SELECT count(*) FROM sub_raw)), "
    f"('colunas', CAST({len(RAW_COLS)} AS BIGINT)), ('tipo_bigint', CAST({len(RAW_LONGS)} AS BIGINT)), "
    f"('tipo_double', CAST({len(RAW_DOUBLES)} AS BIGINT)), ('tipo_string', CAST({len(RAW_STRINGS)} AS BIGINT))"
    ") t(metrica, valor)")
ORACLE["profile_target"] = (
    f"WITH {SUB_RAW} SELECT Churn, count(*) AS contagem, "
    f"{R('count(*) / CAST((SELECT count(*) FROM sub_raw) AS DOUBLE)', 4)} AS proporcao "
    "FROM sub_raw GROUP BY Churn")
ORACLE["profile_nulls"] = (
    f"WITH {SUB_RAW} SELECT coluna, qtd_nan, {R('qtd_nan / CAST(n AS DOUBLE) * CAST(100 AS DOUBLE)', 2)} AS pct "
    "FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, CAST(count_if({c} IS NULL) AS BIGINT) AS qtd_nan, count(*) AS n FROM sub_raw"
        for c in RAW_COLS) + ") WHERE qtd_nan > 0")
ORACLE["profile_disguised"] = (
    f"WITH {SUB_RAW} SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, '{t}' AS valor, CAST(count_if(lower(trim({c})) = '{t}') AS BIGINT) AS contagem FROM sub_raw"
        for c in RAW_STRINGS for t in TOKENS) + ") WHERE contagem > 0")
ORACLE["profile_sentinel_share"] = (
    f"WITH {SUB_RAW} " + " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, '{s}' AS sentinela, "
        f"{R(f'count_if({c} = {v}) / CAST(count(*) AS DOUBLE)', 6)} AS proporcao FROM sub_raw"
        for c, s, v in [("HandsetPrice", "Unknown", "'Unknown'"), ("MaritalStatus", "Unknown", "'Unknown'"),
                        ("Homeownership", "Unknown", "'Unknown'"), ("AgeHH1", "0", "0")]))
ORACLE["profile_cardinality"] = (
    f"WITH {SUB_RAW} " + " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, count(DISTINCT {c}) AS distintos FROM sub_raw" for c in RAW_STRINGS))
ORACLE["profile_domains"] = (
    f"WITH {SUB_RAW} " + " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, valor, CAST(row_number() OVER (ORDER BY valor) AS INTEGER) AS posicao "
        f"FROM (SELECT DISTINCT {c} AS valor FROM sub_raw WHERE {c} IS NOT NULL) "
        f"WHERE (SELECT count(DISTINCT {c}) FROM sub_raw) <= 12" for c in RAW_STRINGS))
ORACLE["profile_describe"] = (
    f"WITH {SUB_RAW} " + rounded(" UNION ALL ".join(
        f"SELECT '{c}' AS coluna, count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean, "
        f"stddev_samp(CAST({c} AS DOUBLE)) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM sub_raw"
        for c in RAW_NUMERIC), ["mean", "std", "min", "q25", "q50", "q75", "max"]))
ORACLE["profile_dup_keys"] = (
    f"WITH {SUB_RAW} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicados "
    "FROM (SELECT count(*) AS n FROM sub_raw GROUP BY CustomerID)")
ORACLE["profile_dup_rows"] = (
    f"WITH {SUB_RAW} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicados "
    f"FROM (SELECT count(*) AS n FROM sub_raw GROUP BY {', '.join(RAW_COLS)})")
ORACLE["profile_negatives"] = (
    f"WITH {SUB_RAW} SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, CAST(count_if({c} < 0) AS BIGINT) AS negativos FROM sub_raw"
        for c in RAW_NUMERIC if c not in ("PercChangeMinutes", "PercChangeRevenues"))
    + ") WHERE negativos > 0")
ORACLE["profile_top_values"] = (
    f"WITH {SUB_RAW} SELECT HandsetPrice AS valor, count(*) AS contagem FROM sub_raw "
    "GROUP BY 1 ORDER BY contagem DESC, valor ASC NULLS FIRST LIMIT 15")
ORACLE["profile_rate_by_quartile"] = f"WITH {SUB_RAW} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS coluna, CAST(faixa AS INTEGER) AS faixa,
         {R('edges[faixa]')} AS limite_inf, {R('edges[least(faixa + 1, len(edges))]')} AS limite_sup,
         {R('avg(y)', 3)} AS taxa, count(*) AS contagem
       FROM (SELECT greatest(1, len(list_filter(e.edges, lambda v: v < x))) AS faixa, e.edges AS edges, y
             FROM (SELECT TRY_CAST({c} AS DOUBLE) AS x, CAST(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS DOUBLE) AS y
                   FROM sub_raw) d
             CROSS JOIN (SELECT list_sort(list_distinct(quantile_cont(TRY_CAST({c} AS DOUBLE),
                           [CAST(0 AS DOUBLE), 0.25, 0.5, 0.75, CAST(1 AS DOUBLE)]))) AS edges FROM sub_raw) e
             WHERE x IS NOT NULL)
       GROUP BY faixa, edges""" for c in ["MonthsInService", "MonthlyRevenue", "CurrentEquipmentDays",
                                          "RetentionCalls"])
ORACLE["audit_treated"] = (
    f"WITH {TREATED} SELECT (SELECT count(*) FROM sub_raw) AS linhas_antes, count(*) AS linhas_depois, "
    "CAST(" + " + ".join(f'count_if("{c}" IS NULL)' for c in ["CustomerID", "Churn"] + TREATED_DOUBLES)
    + " AS BIGINT) AS nulos_restantes, CAST(0 AS BIGINT) AS colunas_nao_numericas, "
    f"{R('avg(CAST(Churn AS DOUBLE))')} AS taxa_alvo FROM sub_treated")
_LOG = [
    (1, "Churn", "map_yes_no", "count(*)", "NULL"),
    (2, "MadeCallToRetentionTeam", "map_yes_no", "count(*)", "NULL"),
    (3, "Homeownership", "known_flag", "count_if(Homeownership = 'Unknown')", "NULL"),
    (4, "MaritalStatus", "one_hot", "count_if(MaritalStatus = 'Unknown')", "NULL"),
    (5, "HandsetPrice", "text_to_number_median", "count_if(HandsetPrice = 'Unknown')", "(SELECT HandsetPrice FROM med)"),
    (6, "AgeHH1", "zero_to_null_median", "count_if(AgeHH1 = 0) + count_if(AgeHH1 IS NULL)", "(SELECT AgeHH1 FROM med)"),
    (7, "CurrentEquipmentDays", "negative_to_null_median",
     "count_if(CurrentEquipmentDays < 0) + count_if(CurrentEquipmentDays IS NULL)",
     "(SELECT CurrentEquipmentDays FROM med)"),
    (8, ", ".join(BILLING), "missing_block_flag_median",
     "count_if(" + " AND ".join(f"{c} IS NULL" for c in BILLING) + ")", "NULL"),
    (9, "PercChangeMinutes", "impute_median", "count_if(PercChangeMinutes IS NULL)", "(SELECT PercChangeMinutes FROM med)"),
    (10, "PercChangeRevenues", "impute_median", "count_if(PercChangeRevenues IS NULL)", "(SELECT PercChangeRevenues FROM med)"),
    (11, "Handsets", "impute_median", "count_if(Handsets IS NULL)", "(SELECT Handsets FROM med)"),
    (12, "CreditRating", "ordinal", "count(*)", "NULL"),
    (13, "PrizmCode", "one_hot_5", "count(*)", "NULL"),
    (14, "Occupation", "one_hot_5", "count(*)", "NULL"),
    (15, "ServiceArea", "frequency", "count_if(ServiceArea IS NULL)", "NULL"),
    (16, "CustomerID", "key_to_index", "count(*)", "NULL"),
]
ORACLE["treatment_log"] = (
    f"WITH {TREATED} SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT CAST({o} AS INTEGER) AS ordem, '{c}' AS coluna, '{a}' AS acao, "
        f"CAST({e} AS BIGINT) AS linhas_afetadas, {R(f'CAST({p} AS DOUBLE)')} AS parametro FROM sub_raw"
        for o, c, a, e, p in _LOG)
    + ") WHERE NOT (coluna IN ('PercChangeMinutes', 'PercChangeRevenues', 'Handsets') AND linhas_afetadas = 0)")

# ----------------------------------------------------------------- curves
SCORES = SUB_RAW + """,
fx_scores AS (SELECT CustomerID,
  CAST((CustomerID * 7919) % 7001 + CASE WHEN Churn = 'Yes' THEN 1500 ELSE 0 END AS DOUBLE) / CAST(10000 AS DOUBLE) AS prob_churn,
  CAST(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS churn_real FROM sub_raw),
sc AS (SELECT CAST(floor(prob_churn * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS prob_bp,
  CAST(count_if(churn_real = 1) AS BIGINT) AS pos, CAST(count_if(churn_real <> 1) AS BIGINT) AS neg FROM fx_scores GROUP BY 1),
cum AS (SELECT prob_bp, pos, neg,
  CAST(sum(pos) OVER (ORDER BY prob_bp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
  CAST(sum(neg) OVER (ORDER BY prob_bp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp,
  CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N FROM sc)"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def metrics_sql(grid: list[int], d: int | None) -> str:
    """tp/fp and metrics at each threshold (basis points) over ``sc``."""
    r = (lambda x: R(x, d)) if d is not None else (lambda x: x)
    vals = ", ".join(f"({t})" for t in grid)
    tc = (f"SELECT g.t_bp, CAST(coalesce(sum(CASE WHEN sc.prob_bp >= g.t_bp THEN sc.pos ELSE 0 END), 0) AS BIGINT) AS tp, "
          f"CAST(coalesce(sum(CASE WHEN sc.prob_bp >= g.t_bp THEN sc.neg ELSE 0 END), 0) AS BIGINT) AS fp, "
          f"CAST((SELECT sum(pos) FROM sc) AS BIGINT) AS P, CAST((SELECT sum(neg) FROM sc) AS BIGINT) AS N "
          f"FROM (VALUES {vals}) g(t_bp) CROSS JOIN sc GROUP BY g.t_bp")
    pr = (f"SELECT *, {_div('tp', 'tp + fp')} AS prec, {_div('tp', 'P')} AS rec FROM ({tc})")
    f1 = _div("CAST(2 AS DOUBLE) * prec * rec", "prec + rec")
    f2 = _div("CAST(5 AS DOUBLE) * prec * rec", "CAST(4 AS DOUBLE) * prec + rec")
    return (f"SELECT t_bp, CAST(t_bp AS DOUBLE) / CAST(10000 AS DOUBLE) AS threshold, tp, fp, N - fp AS tn, "
            f"P - tp AS fn, P, {r('prec')} AS precision, {r('rec')} AS recall, {r(f1)} AS f1, {r(f2)} AS f2, "
            f"tp + fp AS abordados FROM ({pr})")


F2_GRID = list(range(2000, 7001, 500))
RECALL_GRID = list(range(500, 9501, 100))
ORACLE["score_counts"] = f"WITH {SCORES} SELECT * FROM sc"
ORACLE["confusion_at"] = f"WITH {SCORES} SELECT threshold, tp, fp, tn, fn FROM ({metrics_sql([3100], 4)})"
ORACLE["metrics_at"] = (f"WITH {SCORES} SELECT threshold, tp, fp, tn, fn, precision, recall, f1, f2, abordados "
                        f"FROM ({metrics_sql([2500], 4)})")
ORACLE["sweep_f2"] = f"WITH {SCORES} SELECT threshold, recall, precision, f1, f2 FROM ({metrics_sql(F2_GRID, 3)})"
ORACLE["threshold_f2"] = (f"WITH {SCORES} SELECT threshold, f2 FROM ({metrics_sql(F2_GRID, 3)}) "
                          "ORDER BY f2 DESC, threshold ASC LIMIT 1")
ORACLE["sweep_recall"] = (f"WITH {SCORES} SELECT threshold, {R('recall')} AS recall, {R('precision')} AS precision, "
                          f"fp, tp FROM ({metrics_sql(RECALL_GRID, None)})")
ORACLE["threshold_recall"] = (f"WITH {SCORES} SELECT CAST(max(t_bp) AS DOUBLE) / CAST(10000 AS DOUBLE) AS threshold "
                              f"FROM ({metrics_sql(RECALL_GRID, None)}) WHERE P > 0 AND tp * 100 >= 90 * P")
ROC = SCORES + """,
pts AS (SELECT *, lag(pos) OVER w AS pos_prev, lead(pos) OVER w AS pos_next, lead(neg) OVER w AS neg_next
        FROM cum WINDOW w AS (ORDER BY prob_bp DESC)),
roc AS (SELECT CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST((SELECT sum(pos) FROM sc) AS BIGINT) AS P,
               CAST((SELECT sum(neg) FROM sc) AS BIGINT) AS N, CAST(NULL AS DOUBLE) AS limiar
        UNION ALL
        SELECT tp, fp, P, N, CAST(prob_bp AS DOUBLE) / CAST(10000 AS DOUBLE) FROM pts
        WHERE pos_prev IS NULL OR pos_next IS NULL OR pos_next <> pos OR neg_next <> neg),
roc_pts AS (SELECT CAST(row_number() OVER (ORDER BY fp, tp) - 1 AS INTEGER) AS ponto,
                   CAST(fp AS DOUBLE) / CAST(N AS DOUBLE) AS fpr, CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) AS tpr, limiar
            FROM roc)"""
ORACLE["roc_curve"] = f"WITH {ROC} SELECT ponto, {R('fpr')} AS fpr, {R('tpr')} AS tpr, {R('limiar')} AS limiar FROM roc_pts"
ORACLE["roc_200"] = f"""WITH {ROC},
n AS (SELECT count(*) AS n FROM roc_pts),
pick AS (SELECT CAST(i AS INTEGER) AS indice,
                CAST(CASE WHEN (SELECT n FROM n) <= 200 THEN i ELSE (i * ((SELECT n FROM n) - 1)) // 199 END AS INTEGER) AS ponto
         FROM range(200) t(i) WHERE i < (SELECT n FROM n))
SELECT p.indice, {R('r.fpr', 4)} AS fpr, {R('r.tpr', 4)} AS tpr FROM pick p JOIN roc_pts r ON p.ponto = r.ponto"""
ORACLE["auc_roc"] = (f"WITH {SCORES} SELECT {R('sum(CAST(pos AS DOUBLE) * (CAST(N - fp AS DOUBLE) + CAST(neg AS DOUBLE) / 2)) / (CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE))', 9)} AS auc_roc FROM cum")
ORACLE["average_precision"] = (
    f"WITH {SCORES} SELECT {R('sum((CAST(pos AS DOUBLE) / CAST(P AS DOUBLE)) * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)))', 9)} "
    "AS average_precision FROM cum")
ORACLE["score_histogram"] = f"""WITH {SCORES},
b AS (SELECT least(k - CASE WHEN CAST(prob_bp AS DOUBLE) / CAST(10000 AS DOUBLE) < CAST(k AS DOUBLE) * CAST(0.025 AS DOUBLE)
                      THEN 1 ELSE 0 END, 39) AS bin, pos, neg
      FROM (SELECT prob_bp // 250 AS k, prob_bp, pos, neg FROM sc)),
c AS (SELECT bin, sum(neg) AS ficou, sum(pos) AS cancelou FROM b GROUP BY bin)
SELECT CAST(g.bin AS INTEGER) AS bin,
  {R('(CAST(g.bin AS DOUBLE) * CAST(0.025 AS DOUBLE) + CAST(g.bin + 1 AS DOUBLE) * CAST(0.025 AS DOUBLE)) / 2', 3)} AS score,
  CAST(coalesce(c.ficou, 0) AS BIGINT) AS ficou, CAST(coalesce(c.cancelou, 0) AS BIGINT) AS cancelou
FROM range(40) g(bin) LEFT JOIN c ON g.bin = c.bin"""
ORACLE["compare_models"] = f"""WITH {SCORES}, m AS ({metrics_sql([2500, 3100], 4)})
SELECT CASE t_bp WHEN 2500 THEN 'max_f2_025' ELSE 'recall_90_031' END AS modelo, threshold, recall, precision,
       fp, fn, abordados, (SELECT fp FROM m WHERE t_bp = 2500) - fp AS fp_economizados,
       {R('recall - (SELECT recall FROM m WHERE t_bp = 2500)', 4)} AS delta_recall FROM m"""
ORACLE["bundle_meta"] = (
    f"WITH {SCORES} SELECT (SELECT {R('sum(CAST(pos AS DOUBLE) * (CAST(N - fp AS DOUBLE) + CAST(neg AS DOUBLE) / 2)) / (CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE))', 4)} FROM cum) AS auc, "
    f"CAST(0.31 AS DOUBLE) AS threshold_oficial, count(*) AS n_teste, {R('avg(CAST(churn_real AS DOUBLE))', 4)} AS taxa_churn "
    "FROM fx_scores")
ORACLE["risk_ranking"] = (
    f"WITH {SCORES} SELECT CustomerID, {R('prob_churn', 4)} AS prob_churn, churn_real, "
    f"row_number() OVER (ORDER BY {R('prob_churn', 4)} DESC, CustomerID ASC) AS rank_risco FROM fx_scores")

# ------------------------------------------------------- policy / serving
SEG_NAMES = ["Insatisfeito com o servico", "Sensivel a preco", "Aparelho desatualizado",
             "Fim de fidelizacao", "Perfil geral"]
ACTS = [("desconto", "Desconto na mensalidade", 30), ("upgrade", "Upgrade de aparelho subsidiado", 80),
        ("suporte", "Ligacao proativa do suporte", 8), ("bonus", "Pacote de minutos bonus", 15)]
_segs = ", ".join(f"('{s}')" for s in SEG_NAMES)
_acts = ", ".join(f"('{a}', '{n}', CAST({c} AS INTEGER), CAST({i + 1} AS INTEGER))" for i, (a, n, c) in enumerate(ACTS))

POLICY = SEGMENTED + f""",
fx_offers AS (
  SELECT row_number() OVER (ORDER BY e.ts, e.event_id) AS rodada, s.CustomerID, s.segmento,
    CASE e.event_type WHEN 'click' THEN 'desconto' WHEN 'view' THEN 'upgrade'
                      WHEN 'error' THEN 'suporte' WHEN 'purchase' THEN 'bonus' END AS acao,
    CAST(e.value >= 20 AS INTEGER) AS aceitou
  FROM events e JOIN sub_seg s ON e.user_id = s.CustomerID
  WHERE e.event_type IN ('click', 'view', 'error', 'purchase')),
acts AS (SELECT * FROM (VALUES {_acts}) t(acao, nome, custo, posicao)),
grid AS (SELECT s.segmento, a.acao, a.posicao FROM (VALUES {_segs}) s(segmento) CROSS JOIN acts a),
cnt AS (SELECT segmento, acao, count(*) AS n, sum(aceitou) AS acc FROM fx_offers GROUP BY segmento, acao),
pc AS (SELECT g.segmento, g.acao, CAST(coalesce(c.n, 0) AS BIGINT) AS tentativas,
              CAST(coalesce(c.acc, 0) AS BIGINT) AS aceites,
              {R(_div('coalesce(c.acc, 0)', 'coalesce(c.n, 0)'), 4)} AS taxa_estimada, g.posicao
       FROM grid g LEFT JOIN cnt c ON g.segmento = c.segmento AND g.acao = c.acao),
pord AS (SELECT segmento, acao, tentativas, aceites, taxa_estimada,
              CAST(row_number() OVER (PARTITION BY segmento ORDER BY taxa_estimada DESC, posicao) AS INTEGER) AS ordem
       FROM pc),
pb AS (SELECT segmento, acao, taxa_estimada FROM pord WHERE ordem = 1),
reco AS (SELECT s.CustomerID, s.segmento, b.acao, a.nome AS acao_nome, b.taxa_estimada AS taxa_esperada, a.custo
         FROM sub_seg s JOIN pb b ON s.segmento = b.segmento JOIN acts a ON a.acao = b.acao)"""

ORACLE["offer_log"] = f"WITH {POLICY} SELECT * FROM fx_offers"
ORACLE["action_dim"] = (f"WITH {POLICY} SELECT o.rodada, o.CustomerID, o.segmento, o.acao, a.nome AS acao_nome, "
                        "a.custo, o.aceitou FROM fx_offers o LEFT JOIN acts a ON o.acao = a.acao")
ORACLE["policy_counts"] = f"WITH {POLICY} SELECT * FROM pc"
ORACLE["policy_order"] = f"WITH {POLICY} SELECT * FROM pord"
ORACLE["policy_best"] = f"WITH {POLICY} SELECT * FROM pb"
ORACLE["recommend"] = f"WITH {POLICY} SELECT * FROM reco"
LEARN = POLICY + f""",
rates AS (SELECT segmento, acao, CAST(floor(taxa_estimada * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS taxa_bp FROM pc),
reg AS (SELECT r.segmento, r.acao, m.melhor - r.taxa_bp AS regret_bp
        FROM rates r JOIN (SELECT segmento, max(taxa_bp) AS melhor FROM rates GROUP BY segmento) m ON r.segmento = m.segmento),
blk AS (SELECT (o.rodada - 1) // 50 AS bloco, count(*) AS n, sum(o.aceitou) AS aceites, sum(coalesce(g.regret_bp, 0)) AS regret_bp
        FROM fx_offers o LEFT JOIN reg g ON o.segmento = g.segmento AND o.acao = g.acao
        GROUP BY 1 HAVING count(*) = 50),
cur AS (SELECT bloco,
          sum(aceites) OVER (ORDER BY bloco RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS acc_w,
          sum(n) OVER (ORDER BY bloco RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS n_w,
          sum(regret_bp) OVER (ORDER BY bloco ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reg_cum
        FROM blk),
lc AS (SELECT CAST((bloco + 1) * 50 AS BIGINT) AS rodada,
              {R('CAST(acc_w AS DOUBLE) / CAST(n_w AS DOUBLE)', 4)} AS taxa_aceite,
              {R('CAST(reg_cum AS DOUBLE) / CAST(10000 AS DOUBLE) / CAST((bloco + 1) * 50 AS DOUBLE)', 4)} AS regret_medio
       FROM cur)"""
ORACLE["learning_curve"] = f"WITH {LEARN} SELECT * FROM lc"
ORACLE["regret_curve"] = f"WITH {LEARN} SELECT rodada, regret_medio FROM lc"
ORACLE["posterior_mean"] = (f"WITH {POLICY} SELECT segmento, acao, tentativas, aceites, "
                            f"{R('CAST(aceites + 1 AS DOUBLE) / CAST(tentativas + 2 AS DOUBLE)', 4)} AS media_posterior FROM pc")

# A coefficient for every feature column.
COEFS = [
    ("MonthlyRevenue", 0.004), ("MonthlyMinutes", -0.0006), ("TotalRecurringCharge", -0.003), ("DirectorAssistedCalls", 0.01),
    ("OverageMinutes", 0.007), ("RoamingCalls", 0.03), ("PercChangeMinutes", -0.0009), ("PercChangeRevenues", 0.0002),
    ("DroppedBlockedCalls", 0.015), ("UnansweredCalls", 0.012), ("CustomerCareCalls", -0.02), ("ReceivedCalls", -0.04),
    ("OutboundCalls", -0.03), ("InboundCalls", 0.02), ("MonthsInService", -0.011), ("UniqueSubs", 0.12), ("ActiveSubs", -0.09),
    ("Handsets", 0.035), ("CurrentEquipmentDays", 0.0012), ("RetentionCalls", 0.14), ("AgeHH1", -0.006), ("HandsetPrice", -0.0045),
    ("CreditRating", 0.05), ("MadeCallToRetentionTeam", 0.33), ("HomeownershipKnown", -0.08), ("MaritalStatus_No", 0.07),
    ("MaritalStatus_Unknown", 0.045), ("MaritalStatus_Yes", -0.06), ("HandsetPriceKnown", 0.11), ("AgeHH1Known", -0.13),
    ("MissingBillingInfo", 0.9), ("PrizmCode_AFRICA", 0.21), ("PrizmCode_AMERICA", -0.17), ("PrizmCode_ASIA", -0.4),
    ("PrizmCode_EUROPE", 0.19), ("PrizmCode_MIDDLE EAST", 0.16), ("Occupation_AUTOMOBILE", 0.23), ("Occupation_BUILDING", -0.27),
    ("Occupation_FURNITURE", 0.31), ("Occupation_HOUSEHOLD", -0.22), ("Occupation_MACHINERY", 0.26), ("ServiceAreaFreq", 3.0),
    ("ReceitaPorMinuto", 1.5), ("RazaoOverage", 4.0), ("ReceitaPorMes", 0.018), ("FalhasPorChamada", 0.8),
    ("NaoAtendidasPorChamada", 0.37), ("CareCallsPorMes", 2.0), ("RetentionPorMes", 1.7), ("IdadeAparelhoMeses", 0.05),
    ("RazaoAparelhoContrato", 0.42), ("FimFidelizacao", 0.65), ("RazaoSubsAtivos", -0.75), ("QuedaUso", 0.0016)]
_means = ", ".join(f'avg(CAST("{c}" AS DOUBLE)) AS "m_{c}"' for c, _ in COEFS)
_base = "CAST(-1.0 AS DOUBLE)" + "".join(f' + CAST({k!r} AS DOUBLE) * mm."m_{c}"' for c, k in COEFS)
ATTRIB = FEATURES + f""",
mm AS (SELECT {_means} FROM sub_feat),
attr AS ({" UNION ALL ".join(
    f"SELECT f.CustomerID, '{c}' AS variavel, "
    f"CAST({k!r} AS DOUBLE) * (CAST(f.\"{c}\" AS DOUBLE) - mm.\"m_{c}\") AS raw, "
    f"CAST(f.\"{c}\" AS DOUBLE) AS v, {R(_base, 4)} AS base FROM sub_feat f CROSS JOIN mm"
    for c, k in COEFS)}),
top5 AS (SELECT CustomerID, CAST(ordem AS INTEGER) AS ordem, variavel, {R('raw', 4)} AS shap, {R('v', 3)} AS valor, base FROM (
           SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY abs(raw) DESC, variavel) AS ordem FROM attr)
         WHERE ordem <= 5)"""


# Label of each variable.
LABELS = [
    ("CurrentEquipmentDays", "Dias com o aparelho atual"),
    ("IdadeAparelhoMeses", "Idade do aparelho (meses)"),
    ("MonthsInService", "Meses de contrato"),
    ("MonthlyMinutes", "Minutos mensais"),
    ("MonthlyRevenue", "Receita mensal"),
    ("TotalRecurringCharge", "Mensalidade recorrente"),
    ("PercChangeMinutes", "Variacao de minutos (%)"),
    ("PercChangeRevenues", "Variacao de receita (%)"),
    ("OverageMinutes", "Minutos excedentes"),
    ("RazaoOverage", "Proporcao de minutos excedentes"),
    ("ReceitaPorMinuto", "Receita por minuto (preco pago)"),
    ("ReceitaPorMes", "Receita media por mes de contrato"),
    ("DroppedCalls", "Chamadas caidas"),
    ("BlockedCalls", "Chamadas bloqueadas"),
    ("DroppedBlockedCalls", "Chamadas caidas + bloqueadas"),
    ("FalhasPorChamada", "Falhas por chamada (qualidade)"),
    ("NaoAtendidasPorChamada", "Nao atendidas por chamada"),
    ("UnansweredCalls", "Chamadas nao atendidas"),
    ("CustomerCareCalls", "Ligacoes ao atendimento"),
    ("CareCallsPorMes", "Ligacoes ao atendimento por mes"),
    ("RetentionCalls", "Ligacoes a equipe de retencao"),
    ("RetentionPorMes", "Ligacoes a retencao por mes"),
    ("MadeCallToRetentionTeam", "Ja ligou para a retencao"),
    ("RetentionOffersAccepted", "Ofertas de retencao aceitas"),
    ("HandsetPrice", "Preco do aparelho"),
    ("HandsetPriceKnown", "Preco do aparelho informado"),
    ("HandsetRefurbished", "Aparelho recondicionado"),
    ("HandsetWebCapable", "Aparelho com internet"),
    ("Handsets", "Qtde de aparelhos"),
    ("HandsetModels", "Qtde de modelos de aparelho"),
    ("RazaoAparelhoContrato", "Idade do aparelho vs contrato"),
    ("FimFidelizacao", "Fim do periodo de fidelizacao (11-16m)"),
    ("QuedaUso", "Queda recente de uso"),
    ("RazaoSubsAtivos", "Proporcao de linhas ativas"),
    ("UniqueSubs", "Linhas na conta"),
    ("ActiveSubs", "Linhas ativas"),
    ("ReceivedCalls", "Chamadas recebidas"),
    ("OutboundCalls", "Chamadas realizadas"),
    ("InboundCalls", "Chamadas de entrada"),
    ("PeakCallsInOut", "Chamadas em horario de pico"),
    ("OffPeakCallsInOut", "Chamadas fora de pico"),
    ("CallWaitingCalls", "Chamadas em espera"),
    ("ThreewayCalls", "Chamadas em conferencia"),
    ("DirectorAssistedCalls", "Chamadas com auxilio de telefonista"),
    ("RoamingCalls", "Chamadas em roaming"),
    ("CallForwardingCalls", "Chamadas encaminhadas"),
    ("CreditRating", "Nota de credito (1=melhor)"),
    ("AdjustmentsToCreditRating", "Ajustes na nota de credito"),
    ("IncomeGroup", "Faixa de renda"),
    ("AgeHH1", "Idade do titular"),
    ("AgeHH2", "Idade do 2o morador"),
    ("AgeHH1Known", "Idade do titular informada"),
    ("AgeHH2Known", "Idade do 2o morador informada"),
    ("ChildrenInHH", "Criancas em casa"),
    ("HomeownershipKnown", "Imovel proprio informado"),
    ("MissingBillingInfo", "Sem dados de fatura"),
    ("ServiceAreaFreq", "Porte da area de servico"),
    ("NewCellphoneUser", "Usuario novo de celular"),
    ("NotNewCellphoneUser", "Usuario experiente de celular"),
    ("BuysViaMailOrder", "Compra por catalogo"),
    ("RespondsToMailOffers", "Responde a ofertas por correio"),
    ("OptOutMailings", "Recusou mala direta"),
    ("OwnsComputer", "Tem computador"),
    ("HasCreditCard", "Tem cartao de credito"),
    ("ReferralsMadeBySubscriber", "Indicacoes feitas"),
]


def _label_values() -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in LABELS)


def _prefix_label(column: str) -> str:
    rest = f"regexp_extract({column}, '^[^_]*_(.*)$', 1)"
    cases = " ".join(f"WHEN {column} LIKE '{p}\\_%' ESCAPE '\\' THEN '{p}: ' || {rest}"
                     for p in ("MaritalStatus", "PrizmCode", "Occupation"))
    return f"CASE {cases} END"


LABELLED = ATTRIB + f""",
labels AS (SELECT * FROM (VALUES {_label_values()}) t(variavel, rotulo_dic)),
fac AS (SELECT t.*, coalesce(l.rotulo_dic, {_prefix_label('t.variavel')}, t.variavel) AS rotulo
        FROM top5 t LEFT JOIN labels l ON t.variavel = l.variavel)"""

ORACLE["attribution_linear"] = f"WITH {ATTRIB} SELECT CustomerID, variavel, {R('raw', 4)} AS shap, {R('v', 3)} AS valor, base FROM attr"
ORACLE["attribution_top5"] = f"WITH {ATTRIB} SELECT * FROM top5"
ORACLE["attribution_global"] = f"""WITH {LABELLED},
g AS (SELECT variavel, avg(abs(raw)) AS impacto FROM attr GROUP BY variavel ORDER BY impacto DESC, variavel LIMIT 15)
SELECT g.variavel, coalesce(l.rotulo_dic,
          {_prefix_label('g.variavel')},
          g.variavel) AS rotulo, {R('g.impacto', 4)} AS impacto_medio
FROM g LEFT JOIN labels l ON g.variavel = l.variavel"""
ORACLE["factor_labels"] = f"WITH {LABELLED} SELECT CustomerID, ordem, variavel, rotulo FROM fac"
ORACLE["factor_scale"] = (f"WITH {LABELLED} SELECT CustomerID, variavel, shap, "
                          f"{R('abs(shap) / greatest(max(abs(shap)) OVER (PARTITION BY CustomerID), CAST(0.01 AS DOUBLE))', 4)} "
                          "AS escala FROM fac")


SERVE = (POLICY + LABELLED[len(FEATURES):] + SCORES[len(SUB_RAW):] + f""",
rnk AS (SELECT CustomerID, {R('prob_churn', 4)} AS prob_churn, churn_real,
               row_number() OVER (ORDER BY {R('prob_churn', 4)} DESC, CustomerID ASC) AS rank_risco FROM fx_scores),
detail AS (SELECT k.CustomerID, k.prob_churn AS prob, k.rank_risco AS rank, r.segmento, r.acao, r.acao_nome,
                  r.taxa_esperada, f.ordem, f.variavel, f.rotulo, f.shap, f.valor
           FROM rnk k JOIN reco r ON k.CustomerID = r.CustomerID JOIN fac f ON k.CustomerID = f.CustomerID
           WHERE k.rank_risco <= 1000),
queue AS (SELECT DISTINCT CustomerID, prob, rank, segmento, acao_nome, taxa_esperada FROM detail ORDER BY rank LIMIT 200)""")

ORACLE["client_detail"] = f"WITH {SERVE} SELECT * FROM detail"
ORACLE["retention_queue"] = f"WITH {SERVE} SELECT * FROM queue"
ORACLE["queue_search"] = f"WITH {SERVE} SELECT * FROM queue WHERE CAST(CustomerID AS VARCHAR) LIKE '%12%'"
ORACLE["client_lookup"] = (f"WITH {SERVE} SELECT * FROM detail "
                           "WHERE CustomerID = (SELECT CustomerID FROM rnk WHERE rank_risco = 1)")
ORACLE["offer_outcome"] = f"""WITH {SERVE}
SELECT o.rodada, o.CustomerID, o.segmento, o.acao, a.nome AS acao_nome, a.custo, o.aceitou,
       {R('s.prob_churn', 4)} AS risco_antes,
       CASE WHEN o.aceitou = 1 THEN {R(f"{R('s.prob_churn', 4)} * CAST(0.4 AS DOUBLE)", 4)} ELSE {R('s.prob_churn', 4)} END AS risco_depois
FROM fx_offers o JOIN acts a ON o.acao = a.acao JOIN fx_scores s ON o.CustomerID = s.CustomerID"""
ORACLE["next_best_offer"] = f"""WITH {SERVE},
hist AS (SELECT o.CustomerID, max(o.aceitou) AS retido,
                sum(CASE WHEN o.aceitou = 1 THEN a.custo ELSE 0 END) AS custo_total, count(*) AS tentativas
         FROM fx_offers o JOIN acts a ON o.acao = a.acao GROUP BY o.CustomerID),
tried AS (SELECT DISTINCT CustomerID, acao FROM fx_offers),
nxt AS (SELECT s.CustomerID, arg_min(p.acao, p.ordem) AS proxima
        FROM sub_seg s JOIN pord p ON s.segmento = p.segmento
        WHERE NOT EXISTS (SELECT 1 FROM tried t WHERE t.CustomerID = s.CustomerID AND t.acao = p.acao)
        GROUP BY s.CustomerID)
SELECT s.CustomerID, s.segmento, CAST(coalesce(h.retido, 0) AS INTEGER) AS retido,
       CAST(coalesce(h.custo_total, 0) AS BIGINT) AS custo_total, CAST(coalesce(h.tentativas, 0) AS BIGINT) AS tentativas,
       CASE WHEN coalesce(h.retido, 0) = 1 THEN NULL ELSE coalesce(n.proxima, 'encaminhamento_manual') END AS proxima_acao
FROM sub_seg s LEFT JOIN hist h ON s.CustomerID = h.CustomerID LEFT JOIN nxt n ON s.CustomerID = n.CustomerID"""
CAMPAIGN = SERVE + """,
cbase AS (SELECT r.segmento, r.acao_nome,
                 CAST(floor(k.prob_churn * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS p_bp,
                 CAST(floor(r.taxa_esperada * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS r_bp,
                 CAST(r.custo AS BIGINT) AS custo
          FROM reco r JOIN rnk k ON r.CustomerID = k.CustomerID WHERE k.rank_risco <= 500)"""
_salvos = "CAST(sum(p_bp * r_bp) AS DOUBLE) / CAST(1e8 AS DOUBLE)"
_custo = "CAST(sum(custo * r_bp) AS DOUBLE) / CAST(1e4 AS DOUBLE)"
ORACLE["campaign_total"] = f"""WITH {CAMPAIGN}
SELECT CAST(500 AS INTEGER) AS top_n, CAST(600 AS DOUBLE) AS ltv,
  {R('CAST(sum(r_bp) AS DOUBLE) / CAST(1e4 AS DOUBLE)', 1)} AS aceites_esperados,
  {R(_salvos, 1)} AS salvos_esperados,
  {R('CAST(sum(p_bp) AS DOUBLE) / CAST(1e4 AS DOUBLE)', 1)} AS perdidos_sem_acao,
  {R(_custo, 2)} AS custo_esperado,
  {R(f'({_salvos}) * CAST(600 AS DOUBLE)', 2)} AS receita_preservada,
  {R(f'CASE WHEN ({_custo}) <> 0 THEN (({_salvos}) * CAST(600 AS DOUBLE) - ({_custo})) / ({_custo}) ELSE CAST(0 AS DOUBLE) END', 2)} AS roi
FROM cbase"""
ORACLE["campaign_by_segment"] = f"""WITH {CAMPAIGN}
SELECT segmento, acao_nome, count(*) AS clientes,
  {R('CAST(sum(r_bp) AS DOUBLE) / CAST(1e4 AS DOUBLE)', 1)} AS aceites_esperados,
  {R(_salvos, 1)} AS salvos_esperados, {R(_custo, 2)} AS custo
FROM cbase GROUP BY segmento, acao_nome ORDER BY clientes DESC, segmento"""
ORACLE["ranking_preview"] = f"WITH {SERVE} SELECT * FROM rnk ORDER BY rank_risco LIMIT 100"

# ------------------------------------------------------------------ split
TREATED_COLS = (["CustomerID", "Churn"] + BILLING + ["PercChangeMinutes", "PercChangeRevenues",
                "DroppedBlockedCalls", "UnansweredCalls", "CustomerCareCalls", "ReceivedCalls", "OutboundCalls",
                "InboundCalls", "MonthsInService", "UniqueSubs", "ActiveSubs", "Handsets", "CurrentEquipmentDays",
                "RetentionCalls", "AgeHH1", "HandsetPrice", "CreditRating", "MadeCallToRetentionTeam",
                "HomeownershipKnown"] + [f"MaritalStatus_{v}" for v in LEVELS["MaritalStatus"]]
                + ["HandsetPriceKnown", "AgeHH1Known", "MissingBillingInfo"]
                + [f"PrizmCode_{v}" for v in LEVELS["PrizmCode"]] + [f"Occupation_{v}" for v in LEVELS["Occupation"]]
                + ["ServiceAreaFreq"])
FEATURE_COLS = [c for c in TREATED_COLS if c not in ("CustomerID", "Churn")] + list(FEATURE_EXPR)
SPLIT = FEATURES + """,
spl AS (SELECT CustomerID, Churn,
               row_number() OVER (PARTITION BY Churn ORDER BY md5(CAST(CustomerID AS VARCHAR) || '-42'), CustomerID) AS rn,
               count(*) OVER (PARTITION BY Churn) AS ny FROM sub_treated),
sp AS (SELECT CustomerID, Churn, CASE WHEN rn <= (2 * ny + 5) // 10 THEN 'teste' ELSE 'treino' END AS particao,
              rn AS ordem_estrato, ny FROM spl)"""
ORACLE["split_stratified"] = f"WITH {SPLIT} SELECT CustomerID, Churn, particao, ordem_estrato FROM sp"
ORACLE["split_align"] = (f"WITH {SPLIT} " + rounded(
    "SELECT f.* FROM sub_feat f WHERE f.CustomerID IN (SELECT CustomerID FROM sp WHERE particao = 'teste')",
    FEATURE_DOUBLES))
ORACLE["folds_stratified"] = (f"WITH {SPLIT} SELECT CustomerID, Churn, "
                              "CAST((ordem_estrato - (2 * ny + 5) // 10 - 1) % 5 AS INTEGER) AS fold "
                              "FROM sp WHERE particao = 'treino'")
ORACLE["class_weights"] = f"""WITH {SPLIT},
tr AS (SELECT t.Churn FROM sub_treated t JOIN sp ON t.CustomerID = sp.CustomerID WHERE sp.particao = 'treino'),
c AS (SELECT CAST(Churn AS INTEGER) AS classe, count(*) AS n FROM tr GROUP BY 1)
SELECT classe, n, {R('CAST((SELECT sum(n) FROM c) AS DOUBLE) / (CAST(2 AS DOUBLE) * CAST(n AS DOUBLE))')} AS peso,
       {R('CAST((SELECT n FROM c WHERE classe = 0) AS DOUBLE) / CAST((SELECT n FROM c WHERE classe = 1) AS DOUBLE)')} AS scale_pos_weight
FROM c"""
ORACLE["standardise"] = (f"WITH {SPLIT}, tr AS (SELECT f.* FROM sub_feat f JOIN sp ON f.CustomerID = sp.CustomerID "
                         "WHERE sp.particao = 'treino') " + " UNION ALL ".join(
                             f"SELECT '{c}' AS coluna, {R(f'avg(CAST(\"{c}\" AS DOUBLE))')} AS media, "
                             f"{R(f'stddev_pop(CAST(\"{c}\" AS DOUBLE))')} AS desvio FROM tr" for c in FEATURE_COLS))

APPLY = SPLIT + """,
raw_tr AS (SELECT r.* FROM sub_raw r JOIN sp ON r.CustomerID = sp.CustomerID WHERE sp.particao = 'treino'),
raw_te AS (SELECT r.* FROM sub_raw r JOIN sp ON r.CustomerID = sp.CustomerID WHERE sp.particao = 'teste'),
""" + ",\n".join([_median_cte("med_tr", "raw_tr"), _area_cte("area_tr", "raw_tr"),
                  _treated_cte("treated_te", "raw_te", "med_tr", "area_tr")])
ORACLE["apply_params"] = f"WITH {APPLY} " + rounded("SELECT * FROM treated_te", TREATED_DOUBLES)

# ----------------------------------------------------------- sources/sinks
ORACLE["scan_raw"] = ORACLE["scan_subscriber"]
ORACLE["sink_treated"] = ORACLE["treat_all"]
ORACLE["sink_ranking"] = ORACLE["risk_ranking"]
ORACLE["scan_scores"] = ORACLE["risk_ranking"]
ORACLE["sink_params"] = ORACLE["fit_params"]
ORACLE["scan_policy_json"] = ORACLE["policy_order"]
ORACLE["sink_nested_json"] = f"WITH {LABELLED} SELECT CustomerID, ordem, variavel, rotulo FROM fac"
ORACLE["threshold_record"] = (
    f"WITH {SCORES} SELECT CAST(max(t_bp) AS DOUBLE) / CAST(10000 AS DOUBLE) AS threshold, "
    "'max precisao com recall OOF >= 0.9' AS criterio, CAST(1 AS INTEGER) AS usa_features_derivadas "
    f"FROM ({metrics_sql(RECALL_GRID, None)}) WHERE P > 0 AND tp * 100 >= 90 * P")
ORACLE["policy_stream"] = ORACLE["policy_counts"]

ORACLE["factor_scale_global"] = f"""WITH {LABELLED},
g AS (SELECT variavel, avg(abs(raw)) AS impacto FROM attr GROUP BY variavel ORDER BY impacto DESC, variavel LIMIT 15),
gl AS (SELECT g.variavel, coalesce(l.rotulo_dic,
          {_prefix_label('g.variavel')},
          g.variavel) AS rotulo, {R('g.impacto', 4)} AS impacto_medio
       FROM g LEFT JOIN labels l ON g.variavel = l.variavel),
r AS (SELECT *, row_number() OVER (ORDER BY impacto_medio DESC, variavel) AS pos FROM gl)
SELECT variavel, rotulo, impacto_medio, {R('impacto_medio / max(impacto_medio) OVER ()', 4)} AS escala FROM r WHERE pos <= 10"""

ORACLE["next_offer_upsert"] = ORACLE["next_best_offer"]
_members = """('meta', CAST(1 AS BIGINT)), ('roc', (SELECT least(count(*), 200) FROM roc_pts)),
  ('distribuicao', CAST(40 AS BIGINT)), ('politica', (SELECT count(*) FROM pord))"""
ORACLE["publication_manifest"] = f"""WITH {SERVE}{ROC[len(SCORES):]},
auc AS (SELECT a FROM (SELECT auc_roc AS a FROM ({ORACLE['auc_roc']}))),
m AS (
  SELECT CAST(1 AS BIGINT) AS versao, membro, linhas, a AS metrica, true AS promovida FROM (VALUES {_members}) t(membro, linhas), auc
  UNION ALL SELECT 2, 'politica', (SELECT count(*) FROM pord), 1 - a, 1 - a >= a FROM auc
  UNION ALL SELECT 3, membro, linhas, a, a >= 1 - a FROM (VALUES {_members},
    ('ranking', (SELECT least(count(*), 100) FROM fx_scores))) t(membro, linhas), auc)
SELECT versao, membro, linhas, {R('metrica', 6)} AS metrica, promovida, versao = 3 AS atual FROM m"""

# second score table, its own recall threshold, and both models side by side
SCORES_2 = SCORES.replace("(CustomerID * 7919) % 7001 + CASE WHEN Churn = 'Yes' THEN 1500", "(CustomerID * 104729) % 6301 + CASE WHEN Churn = 'Yes' THEN 2300")
ORACLE["compare_two_models"] = f"""WITH old AS (WITH {SCORES} SELECT * FROM ({metrics_sql([2500], 4)})),
new AS (WITH {SCORES_2}, t AS (SELECT max(t_bp) AS best FROM ({metrics_sql(RECALL_GRID, None)}) WHERE P > 0 AND tp * 100 >= 90 * P)
        SELECT m.* FROM ({metrics_sql(RECALL_GRID, 4)}) m JOIN t ON m.t_bp = t.best),
both_ AS (SELECT 'anterior' AS modelo, * FROM old UNION ALL SELECT 'melhorado', * FROM new)
SELECT modelo, threshold, recall, precision, fp, fn, abordados, (SELECT fp FROM old) - fp AS fp_economizados,
       {R('recall - (SELECT recall FROM old)', 4)} AS delta_recall FROM both_"""
# a full recount of the score table after the three change sets
SCORES_3 = SCORES.replace("sc AS (SELECT", """fx_moved AS (
  SELECT CustomerID, churn_real,
         CASE WHEN CustomerID % 13 = 5 THEN bp WHEN CustomerID % 5 = 1 THEN (bp * 3 + 17) % 10001
              WHEN CustomerID % 7 = 3 THEN (bp + 2500) % 10001 ELSE bp END / CAST(10000 AS DOUBLE) AS prob_churn
  FROM (SELECT *, CAST(floor(prob_churn * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS bp FROM fx_scores)
  WHERE CustomerID % 13 = 5 OR CustomerID % 11 <> 2),
sc AS (SELECT""", 1).replace("FROM fx_scores GROUP BY 1)", "FROM fx_moved GROUP BY 1)")
ORACLE["score_counts_delta"] = f"WITH {SCORES_3} SELECT * FROM sc"
ORACLE["curves_delta"] = ORACLE["auc_roc"].replace(SCORES, SCORES_3).replace(" FROM cum", ", " + ORACLE["average_precision"].split("SELECT ")[-1])
ORACLE["standardised"] = (f"WITH {SPLIT}, tr AS (SELECT f.* FROM sub_feat f JOIN sp ON f.CustomerID = sp.CustomerID WHERE sp.particao = 'treino'), st AS (SELECT "
                          + ", ".join(f"avg(CAST(\"{c}\" AS DOUBLE)) AS m{i}, stddev_pop(CAST(\"{c}\" AS DOUBLE)) AS s{i}" for i, c in enumerate(FEATURE_COLS))
                          + " FROM tr) SELECT CustomerID, "
                          + ", ".join(R(f"(CAST(\"{c}\" AS DOUBLE) - m{i}) / (CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END)") + f' AS "{c}"' for i, c in enumerate(FEATURE_COLS))
                          + " FROM sub_feat, st")
ORACLE["client_lookup_bucketed"] = f"WITH {SERVE} SELECT * FROM rnk WHERE rank_risco = 1"
ORACLE["client_search"] = f"WITH {SERVE} SELECT * FROM rnk WHERE CAST(CustomerID AS VARCHAR) LIKE '%112%'"
ORACLE["policy_state_counts"] = ORACLE["policy_counts"]
ORACLE["policy_state_curve"] = f"SELECT rodada, taxa_aceite FROM ({ORACLE['learning_curve']})"
TEXT_COLS = ["Churn", "ServiceArea", "HandsetPrice", "CreditRating", "PrizmCode", "Occupation", "MaritalStatus", "Homeownership", "MadeCallToRetentionTeam"]
ORACLE["profile_store_columns"] = f"WITH {SUB_RAW} " + " UNION ALL ".join(
    f"SELECT '{c}' AS coluna, count(*) AS linhas, count(*) - count({c}) AS nulos, count(DISTINCT {c}) AS distintos FROM sub_raw" for c in TEXT_COLS)
ORACLE["profile_store_top"] = ORACLE["profile_top_values"]


def _member(name: str, sql: str, columns: list[str]) -> str:
    """Rows of a member and the sum of all its numbers to four decimals."""
    each = " + ".join(f"CAST(floor(coalesce(CAST({c} AS DOUBLE), 0) * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)" for c in columns)
    return f"SELECT '{name}' AS membro, count(*) AS linhas, CAST(coalesce(sum({each}), 0) AS VARCHAR) AS soma FROM ({sql})"


ACTION_VALUES = "('desconto', 30, 1), ('upgrade', 80, 2), ('suporte', 8, 3), ('bonus', 15, 4)"
ORACLE["bundle_export"] = " UNION ALL ".join([
    _member("meta", ORACLE["bundle_meta"], ["auc", "threshold_oficial", "n_teste", "taxa_churn"]),
    _member("scores", ORACLE["risk_ranking"], ["CustomerID", "prob_churn", "churn_real", "rank_risco"]),
    _member("roc", ORACLE["roc_200"], ["indice", "fpr", "tpr"]),
    _member("distribuicao", ORACLE["score_histogram"], ["bin", "score", "ficou", "cancelou"]),
    _member("ranking", ORACLE["ranking_preview"], ["CustomerID", "prob_churn", "churn_real", "rank_risco"]),
    _member("shap_global", ORACLE["attribution_global"], ["impacto_medio"]),
    _member("acoes", f"SELECT * FROM (VALUES {ACTION_VALUES}) t(acao, custo, posicao)", ["custo", "posicao"]),
    _member("segmentos", "SELECT unnest([1, 2, 3, 4, 5]) AS posicao", ["posicao"]),
    _member("distribuicao_segmentos", ORACLE["segment_sizes"], ["clientes"]),
    _member("politica", ORACLE["policy_order"], ["tentativas", "aceites", "taxa_estimada", "ordem"]),
    _member("melhor_acao", ORACLE["policy_best"], ["taxa_estimada"]),
    _member("rodadas", f"SELECT count(*) AS rodadas FROM ({ORACLE['offer_log']})", ["rodadas"]),
    _member("curva", ORACLE["learning_curve"], ["rodada", "taxa_aceite", "regret_medio"]),
    _member("clientes_detalhe", f"SELECT DISTINCT CustomerID, prob, rank, taxa_esperada FROM ({ORACLE['client_detail']})", ["CustomerID", "prob", "rank", "taxa_esperada"]),
])
