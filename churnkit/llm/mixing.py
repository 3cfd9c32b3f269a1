"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.functions.ordering import global_index
from churnkit.llm.common import WORD, fresh, materialise, text_of

#: weights dealt to the sources in the order of their names, repeating
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5  # the mix's size, in sizes of the input
MOST = 2.0  # times a source's size that its target may be
LEAF = 4096  # documents in a leaf of the reduction tree, on average
FAN = 1024  # residuals combined in one step above the leaves


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size, n_docs) -> with weight and target.

    Shares ``share`` times all sizes in proportion to the weights; a target stops
    at ``most`` times its source's size and the excess is shared again by weight
    among the others.  That is target = min(cap, level * weight); the level rises
    until the targets use up the total, one small aggregate per step.
    """
    ranked = global_index(sizes, [F.col("source").asc_nulls_last()], "position")
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = materialise(ranked.select("source", "source_size", "n_docs", each.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap")), "sources")
    total = (t.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, -1.0
    while level > before:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, open_weight = t.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        before = level
        if open_weight:
            level = max(level, (total - (capped or 0.0)) / open_weight)
    return t.select("source", "source_size", "n_docs", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round probabilities in order, keeping sum(p * size): (rounded p, index of the one left fractional or -1).

    The open item and the next one trade mass: one goes up and the other down by
    equal words until one of them is 0 or 1, either way with the chance that keeps
    each probability's mean.
    """
    p, draw, open_at = p.astype(float).copy(), rng.random(len(p)), -1
    for k in range(len(p)):
        if not 0.0 < p[k] < 1.0:
            continue
        if open_at < 0:
            open_at = k
            continue
        a, b, sa, sb = p[open_at], p[k], size[open_at], size[k]
        up = min((1 - a) * sa, b * sb)  # words that may move from k to the open item, and back
        down = min(a * sa, (1 - b) * sb)
        moved = up if draw[k] * (up + down) < down else -down
        a, b = a + moved / sa, b - moved / sb
        a, b = (round(x) if abs(x - round(x)) < 1e-9 else x for x in (a, b))
        if moved > 0 and 0 < a < 1 and 0 < b < 1:  # rounding error only: the binding end is settled
            a, b = (1.0, b) if (1 - p[open_at]) * sa <= p[k] * sb else (a, 0.0)
        p[open_at], p[k] = a, b
        open_at = open_at if 0.0 < a < 1.0 else k if 0.0 < b < 1.0 else -1
    return p, open_at


def _seeded(*parts) -> np.random.Generator:
    import xxhash
    return np.random.default_rng(xxhash.xxh64_intdigest(repr(parts).encode()))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, copies, weight, source, text_hash, again.

    A document of a source with target/source_size = r is taken floor(r) or
    floor(r) + 1 times; the fractional parts are rounded by ``pivot`` in leaves of
    the source's documents, the one residual of each leaf is combined with others
    in groups of ``FAN``, level by level, and a seeded coin settles the last one
    of a source.  So a source's taken words miss its target by at most one
    document.  Runs agree: order and draws come from hashes of id and text.
    Null text counts as empty and documents of no words take a coin of their own;
    a null source is a source, the last one; a null id stays null.  ``again``
    numbers rows that repeat source, id and text.  An empty table gives an empty
    result; other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                      F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
                      F.xxhash64(text_of(text_col)).alias("text_hash"))
    src = src.withColumn("again", F.row_number().over(Window.partitionBy("source", "id", "text_hash").orderBy("size")))
    base = materialise(src, "sizes")
    t = materialise(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")),
                            weights, share, most), "targets")
    ts = t.withColumnRenamed("source", "s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.abs(F.col("r") - F.round("r")) < 1e-12
    dealt = (base.join(ts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
             .withColumn("r", ratio).withColumn("r", F.when(near, F.round("r")).otherwise(F.col("r")))
             .withColumn("floor", F.floor("r").cast("long"))
             .withColumn("deal", F.xxhash64("id", "text_hash", "again", F.lit(seed)))
             .withColumn("leaf", F.pmod("deal", F.ceil(F.col("n_docs") / LEAF))))

    def leaf(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["deal", "id", "text_hash", "again"], kind="stable")
        size, p = pdf["size"].to_numpy().astype(float), (pdf["r"] - pdf["floor"]).to_numpy()
        words, rng = size > 0, _seeded(seed, "leaf", key)
        done, left = p.copy(), np.full(len(p), np.nan)
        done[~words] = rng.random(int((~words).sum())) < p[~words]
        at = np.flatnonzero(words)
        rounded, open_at = pivot(p[at], size[at], rng)
        done[at] = rounded
        if open_at >= 0:
            left[at[open_at]] = done[at[open_at]]
            done[at[open_at]] = 0.0
        return pdf.assign(up=np.rint(done).astype("int64"), left=left)[names]

    names = ["id", "source", "size", "source_size", "target", "weight", "text_hash", "again", "floor", "leaf", "up", "left"]
    schema = ("id long, source string, size long, source_size long, target double, weight double, text_hash long, again int, "
              "floor long, leaf long, up long, left double")
    rows = materialise(dealt.groupBy("source", "leaf").applyInPandas(leaf, schema), "leaves")

    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf", kind="stable")
        p, open_at = pivot(pdf["left"].to_numpy(), pdf["size"].to_numpy().astype(float), _seeded(seed, "up", key))
        left = np.full(len(p), np.nan)
        if open_at >= 0:
            left[open_at] = p[open_at]
            p[open_at] = 0.0
        return pdf.assign(up=np.rint(p).astype("int64"), left=left)[["source", "leaf", "size", "up", "left"]]

    opened = F.col("left").isNotNull() & ~F.isnan("left")
    rest = materialise(rows.where(opened).select("source", "leaf", "size", "left"), "residuals")
    settled, span = None, 1
    while not rest.groupBy("source").count().where("count > 1").isEmpty():
        span *= FAN
        step = materialise(rest.withColumn("grp", F.floor(F.col("leaf") / span)).groupBy("source", "grp")
                           .applyInPandas(combine, "source string, leaf long, size long, up long, left double"), "combined")
        done = step.where(~opened).select("source", "leaf", "up")
        settled = done if settled is None else settled.unionByName(done)
        rest = step.where(opened).select("source", "leaf", "size", "left")
    coin = F.pmod(F.xxhash64("source", "leaf", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    last = rest.select("source", "leaf", (coin < F.col("left")).cast("long").alias("up"))
    settled = materialise(last if settled is None else settled.unionByName(last), "settled") \
        .select(F.col("source").alias("s"), F.col("leaf").alias("l"), F.col("up").alias("up2"))
    fixed = rows.where(~opened).drop("left", "leaf")
    late = rows.where(opened).join(settled, F.col("source").eqNullSafe(F.col("s")) & (F.col("leaf") == F.col("l"))) \
        .withColumn("up", F.col("up2")).drop("left", "leaf", "s", "l", "up2")
    out = fixed.unionByName(late).withColumn("copies", F.col("floor") + F.col("up"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                      "copies", "weight", F.col("source").alias(source_col), "text_hash", "again")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns with their values.

    Rows that repeat id, source and text are planned and taken one by one; null
    ids, sources and texts are values like others (a null text is empty and a
    document of no words is taken or not by a coin); columns named like the
    operator's own pass through; an empty table stays empty.
    """
    mid, msource, mhash, magain, copies, number, copy = fresh(docs, "m_id", "m_source", "m_hash", "m_again", "m_copies", "m_number", "m_copy")
    plan = mix(docs, id_col, text_col, source_col, **options).where("copies > 0")
    plan = materialise(plan.select(F.col(id_col).alias(mid), F.col(source_col).alias(msource), F.col("text_hash").alias(mhash),
                                   F.col("again").alias(magain), F.col("copies").cast("int").alias(copies)), "mix")
    own = [F.col(source_col).cast("string"), F.col(id_col).cast("long"), F.xxhash64(text_of(text_col))]
    key = own[0].eqNullSafe(F.col(msource)) & own[1].eqNullSafe(F.col(mid)) & (own[2] == F.col(mhash))
    rows = docs
    if not plan.where(F.col(magain) > 1).isEmpty():  # rows that repeat are told apart by their number
        rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(*own).orderBy(F.octet_length(text_of(text_col)))))
        key = key & (F.col(number) == F.col(magain))
    taken = rows.join(plan, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
