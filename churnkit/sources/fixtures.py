"""Adapter from the driver's tables to the subscriber schema (FIXTURES.md 5).

One row per ``customer``.  Orders before the cut-off day feed the columns,
orders on or after it feed the label.  Everything is a DataFrame plan: the
big inputs (orders, lineitem, events) are aggregated per customer before
they meet ``customer``; nation and region (fixed 25 and 5 rows) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.sources.tables import table

# Fixed values of the adapter (FIXTURES.md section 5).
CUTOFF_DAY = "2001-01-06"
ANCHOR_DAY = "2001-01-01"
OVERAGE_ABOVE = 40.0
RECENT_DAYS = 365
PRIOR_DAYS = 730
ACTIVE_DAYS = 1095
DEFAULT_CREDIT = "4-NOT SPECIFIED"
URGENT = "1-URGENT"
# Fixture credit labels and their ordinal rank (order priorities, 1..5).
FIXTURE_CREDIT_ORDER = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3,
                        "4-NOT SPECIFIED": 4, "5-LOW": 5}
# Offer fixture: event type -> action, acceptance when value >= 20.
EVENT_ACTION = {"click": "desconto", "view": "upgrade", "error": "suporte",
                "purchase": "bonus"}
ACCEPT_VALUE = 20.0

RAW_COLUMNS = [
    "CustomerID", "Churn", "MonthlyRevenue", "MonthlyMinutes", "TotalRecurringCharge",
    "DirectorAssistedCalls", "OverageMinutes", "RoamingCalls", "PercChangeMinutes",
    "PercChangeRevenues", "DroppedBlockedCalls", "UnansweredCalls", "CustomerCareCalls",
    "ReceivedCalls", "OutboundCalls", "InboundCalls", "MonthsInService", "UniqueSubs",
    "ActiveSubs", "Handsets", "CurrentEquipmentDays", "RetentionCalls", "AgeHH1",
    "ServiceArea", "HandsetPrice", "CreditRating", "PrizmCode", "Occupation",
    "MaritalStatus", "Homeownership", "MadeCallToRetentionTeam",
]


def _dbl(c):
    return c.cast("double")


def subscriber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw subscriber table (the reference's 58-column CSV, subset present here)."""
    orders = table(spark, sf_dir, "orders")
    cutoff = F.lit(CUTOFF_DAY).cast("date")
    pre = (orders.where(F.col("o_orderdate") < cutoff)
                 .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                         "o_orderpriority",
                         F.datediff(F.lit(ANCHOR_DAY).cast("date"),
                                    F.col("o_orderdate").cast("date")).alias("days")))
    price = F.col("o_totalprice") / F.lit(1000.0)
    days = F.col("days")
    # priorities as small integer codes: fixed-width buffers keep the
    # aggregation hash-based, and a bitmask replaces count(DISTINCT ...)
    levels = sorted(FIXTURE_CREDIT_ORDER, key=FIXTURE_CREDIT_ORDER.get)
    code = F.create_map(*[F.lit(x) for lv in levels for x in (lv, FIXTURE_CREDIT_ORDER[lv])])[
        F.col("o_orderpriority")]
    bit = F.create_map(*[F.lit(x) for lv in levels for x in (lv, 1 << FIXTURE_CREDIT_ORDER[lv])])[
        F.col("o_orderpriority")]
    po = pre.groupBy("o_custkey").agg(
        F.avg("o_totalprice").alias("avg_price"),
        F.max("o_totalprice").alias("max_price"),
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if(F.col("o_orderstatus") == "O").alias("n_o"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
        F.count_if(F.col("o_orderstatus") == "P").alias("n_p"),
        F.count_if(F.col("o_orderpriority") == URGENT).alias("n_urgent"),
        F.bit_count(F.bit_or(bit)).cast("long").alias("uniq"),
        F.coalesce(F.bit_count(F.bit_or(F.when(days <= ACTIVE_DAYS, bit))), F.lit(0)).cast("long").alias("active"),
        F.min("days").alias("min_days"),
        F.max_by(code, "o_orderkey").alias("credit_code"),
        F.sum(F.when(days <= RECENT_DAYS, price)).alias("rev_recent"),
        F.sum(F.when((days > RECENT_DAYS) & (days <= PRIOR_DAYS), price)).alias("rev_prior"),
    )
    # lineitems are reduced to one row per order first (map-side partial
    # aggregation), so an order holding a large share of the lines never
    # reaches the join with orders as a hot key
    q = F.col("l_quantity")
    per_order = (table(spark, sf_dir, "lineitem")
                 .groupBy("l_orderkey").agg(
                     F.sum(q).alias("q"),
                     F.sum(F.when(q > OVERAGE_ABOVE, q - F.lit(OVERAGE_ABOVE)).otherwise(F.lit(0.0)))
                      .alias("over"),
                     F.count_if(F.col("l_linestatus") == "O").alias("lo"),
                     F.count_if(F.col("l_returnflag") == "R").alias("r")))
    qq = F.col("q")
    pl = (per_order.join(pre.select("o_orderkey", "o_custkey", "days"),
                         per_order.l_orderkey == pre.o_orderkey)
            .groupBy("o_custkey").agg(
                F.sum(qq).alias("minutes"),
                F.sum("over").alias("overage"),
                F.sum("lo").alias("n_lo"),
                F.sum("r").alias("n_r"),
                F.sum(F.when(days <= RECENT_DAYS, qq)).alias("q_recent"),
                F.sum(F.when((days > RECENT_DAYS) & (days <= PRIOR_DAYS), qq)).alias("q_prior")))
    post = (orders.where(F.col("o_orderdate") >= cutoff)
                  .select(F.col("o_custkey").alias("post_key")).distinct())
    ev = (table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("n_error"),
        F.count_if(F.col("event_type") == "view").alias("n_view")))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    cust = (table(spark, sf_dir, "customer")
            .select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")))
    j = (cust.join(po, cust.c_custkey == po.o_custkey, "left")
             .join(pl.withColumnRenamed("o_custkey", "pl_key"),
                   F.col("c_custkey") == F.col("pl_key"), "left")
             .join(post, F.col("c_custkey") == F.col("post_key"), "left")
             .join(ev, F.col("c_custkey") == F.col("user_id"), "left"))
    k = F.col("c_custkey")
    z = F.lit(0)
    care = F.coalesce(F.col("n_r"), z)
    # guard the index: element_at(literal array, NULL) does not give NULL here
    credit = F.when(F.col("credit_code").isNotNull(),
                    F.element_at(F.array(*[F.lit(lv) for lv in levels]), F.col("credit_code"))
                    ).otherwise(F.lit(DEFAULT_CREDIT))
    urgent = F.coalesce(F.col("n_urgent"), z)
    return j.select(
        k.alias("CustomerID"),
        F.when(F.col("post_key").isNull(), "Yes").otherwise("No").alias("Churn"),
        (F.col("avg_price") / F.lit(1000.0)).alias("MonthlyRevenue"),
        F.col("minutes").alias("MonthlyMinutes"),
        (F.col("max_price") / F.lit(1000.0)).alias("TotalRecurringCharge"),
        _dbl(F.col("n_lo")).alias("DirectorAssistedCalls"),
        F.col("overage").alias("OverageMinutes"),
        _dbl(F.col("n_p")).alias("RoamingCalls"),
        (F.col("q_recent") - F.col("q_prior")).alias("PercChangeMinutes"),
        (F.col("rev_recent") - F.col("rev_prior")).alias("PercChangeRevenues"),
        _dbl(care + F.coalesce(F.col("n_error"), z)).alias("DroppedBlockedCalls"),
        _dbl(F.coalesce(F.col("n_view"), z)).alias("UnansweredCalls"),
        _dbl(care).alias("CustomerCareCalls"),
        _dbl(F.coalesce(F.col("n_p"), z)).alias("ReceivedCalls"),
        _dbl(F.coalesce(F.col("n_o"), z)).alias("OutboundCalls"),
        _dbl(F.coalesce(F.col("n_f"), z)).alias("InboundCalls"),
        (F.lit(6) + k % 56).cast("long").alias("MonthsInService"),
        F.coalesce(F.col("uniq"), F.lit(1)).cast("long").alias("UniqueSubs"),
        F.coalesce(F.col("active"), z).cast("long").alias("ActiveSubs"),
        _dbl(F.col("n_orders")).alias("Handsets"),
        _dbl(F.col("min_days")).alias("CurrentEquipmentDays"),
        urgent.cast("long").alias("RetentionCalls"),
        F.when(k % 50 == 0, F.lit(None).cast("double"))
         .when(k % 4 == 0, F.lit(0.0))
         .otherwise(_dbl(F.lit(18) + k % 70)).alias("AgeHH1"),
        F.when(k % 200 == 7, F.lit(None).cast("string"))
         .otherwise(F.concat_ws("-", F.col("n_name"), F.col("c_mktsegment"))).alias("ServiceArea"),
        F.when(credit == DEFAULT_CREDIT, F.lit("Unknown"))
         .otherwise((F.lit(10) * (F.lit(1) + F.coalesce(F.col("n_orders"), z) % 10))
                    .cast("string")).alias("HandsetPrice"),
        credit.alias("CreditRating"),
        F.col("r_name").alias("PrizmCode"),
        F.col("c_mktsegment").alias("Occupation"),
        F.when(k % 5 <= 1, "Unknown").when(k % 5 <= 3, "Yes").otherwise("No").alias("MaritalStatus"),
        F.when(F.col("c_acctbal") > 3000, "Known").otherwise("Unknown").alias("Homeownership"),
        F.when(urgent > 2, "Yes").otherwise("No").alias("MadeCallToRetentionTeam"),
    )


def scores(spark: SparkSession, sf_dir: str, sub: DataFrame | None = None) -> DataFrame:
    """Score table ``fx_scores``: CustomerID, prob_churn (4 dp), churn_real.

    ``sub`` is an already built subscriber table (saves re-planning it)."""
    sub = (sub if sub is not None else subscriber(spark, sf_dir)).select("CustomerID", "Churn")
    churn = (F.col("Churn") == "Yes")
    bp = (F.col("CustomerID") * 7919) % 7001 + F.when(churn, 1500).otherwise(0)
    return sub.select(
        F.col("CustomerID"),
        (bp.cast("double") / F.lit(10000.0)).alias("prob_churn"),
        churn.cast("int").alias("churn_real"))


def challenger_scores(spark: SparkSession, sf_dir: str, sub: DataFrame) -> DataFrame:
    """A second model's score table over the same customers, in the form of ``scores``."""
    churn = F.col("Churn") == "Yes"
    bp = (F.col("CustomerID") * 104729) % 6301 + F.when(churn, 2300).otherwise(0)
    return sub.select("CustomerID", (bp.cast("double") / F.lit(10000.0)).alias("prob_churn"), churn.cast("int").alias("churn_real"))


def offer_events(spark: SparkSession, sf_dir: str, segments: DataFrame) -> DataFrame:
    """Offers in no order: ``(ts, event_id, CustomerID, segmento, acao, aceitou)``.

    One offer per event of a known customer (``signup`` excluded); the segment is
    the customer's rule segment from ``segments`` ``(CustomerID, segmento)``.
    Counters need no more than this: one join, no sort; a customer with a large
    share of the events is split over several tasks.
    """
    from churnkit.functions.heavy import heavy_split_join
    ev = (table(spark, sf_dir, "events")
          .where(F.col("event_type").isin(list(EVENT_ACTION)))
          .select("event_id", "ts", F.col("user_id").alias("CustomerID"), "event_type", "value"))
    amap = F.create_map(*[F.lit(x) for kv in EVENT_ACTION.items() for x in kv])
    return (heavy_split_join(ev, segments.select("CustomerID", "segmento"), "CustomerID", ["event_id"])
              .select("ts", "event_id", "CustomerID", "segmento", amap[F.col("event_type")].alias("acao"),
                      (F.col("value") >= ACCEPT_VALUE).cast("int").alias("aceitou")))


def offers(spark: SparkSession, sf_dir: str, segments: DataFrame) -> DataFrame:
    """Offer log ``(rodada, CustomerID, segmento, acao, aceitou)``: ``offer_events``
    with the dense 1..n round number in (ts, event_id) order, made without a
    single-partition window."""
    from churnkit.functions.ordering import global_index

    log = global_index(offer_events(spark, sf_dir, segments), [F.col("ts").asc(), F.col("event_id").asc()], "rodada")
    return log.select("rodada", "CustomerID", "segmento", "acao", "aceitou")
