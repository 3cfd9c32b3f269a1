"""Exact quantiles (linear interpolation) by distributed selection.

Spark's exact ``percentile`` keeps every distinct value of a column in one
final task.  Here each wanted rank is enclosed between two values of
``percentile_approx``; one counting pass says how many rows lie below, on and
between them.  A rank that falls on an end is that value, however many rows
hold it; any other lies strictly between, and the next round works on these
rows only.  When at most ``max_bracket`` rows are left between, their distinct
values are read.  The result is exact: the same value as ``quantile_cont`` /
``pandas.Series.quantile``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Rank:
    """One wanted rank (0-based) of one column; the value is above lo and below hi until it is known."""

    def __init__(self, col: str, rank: int, n: int):
        self.col, self.rank = col, rank
        self.lo = self.hi = None
        self.below, self.inside = 0, n
        self.value: float | None = None

    def between(self):
        c = F.col(self.col)
        cond = c.isNotNull()
        if self.lo is not None:
            cond = cond & (c > F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (c < F.lit(self.hi))
        return cond


def _narrow(df: DataFrame, todo: list[_Rank], accuracy: int) -> None:
    """One round: two passes over the rows, for all ranks together."""
    # ranks of one column with the same bracket share one sketch
    sketches: dict[tuple, list[int]] = {}
    for k, r in enumerate(todo):
        sketches.setdefault((r.col, r.lo, r.hi), []).append(k)
    asks = []
    for j, members in enumerate(sketches.values()):
        shares = []
        for r in (todo[k] for k in members):
            m, p = max(4.0 / accuracy, 2.0 / r.inside), (r.rank - r.below + 0.5) / r.inside
            shares += [F.lit(max(0.0, p - m)), F.lit(min(1.0, p + m))]
        one = todo[members[0]]
        asks.append(F.percentile_approx(F.when(one.between(), F.col(one.col)), F.array(*shares), accuracy).alias(f"a{j}"))
    got = df.agg(*asks).first()
    ends = {k: got[f"a{j}"][2 * i:2 * i + 2] for j, members in enumerate(sketches.values()) for i, k in enumerate(members)}
    counts = []
    for k, r in enumerate(todo):
        (lo, hi), c = ends[k], F.col(r.col)
        inside = r.between()
        counts += [F.count_if(inside & (c < F.lit(lo))).alias(f"b{k}"), F.count_if(inside & (c == F.lit(lo))).alias(f"l{k}"),
                   F.count_if(inside & (c > F.lit(lo)) & (c < F.lit(hi))).alias(f"m{k}"),
                   F.count_if(inside & (c == F.lit(hi))).alias(f"h{k}")]
    got = df.agg(*counts).first()
    for k, r in enumerate(todo):
        (lo, hi), at = ends[k], r.rank - r.below
        below, on_lo, mid, on_hi = (int(got[f"{x}{k}"]) for x in "blmh")
        if lo == hi:
            on_hi = 0
        if at < below:  # the approximation missed the rank on this side
            r.hi, r.inside = lo, below
        elif at < below + on_lo:
            r.value = float(lo)
        elif at < below + on_lo + mid:
            r.lo, r.hi, r.below, r.inside = lo, hi, r.below + below + on_lo, mid
        elif at < below + on_lo + mid + on_hi:
            r.value = float(hi)
        else:
            r.lo, r.below, r.inside = hi, r.below + below + on_lo + mid + on_hi, r.inside - below - on_lo - mid - on_hi


def _read(df: DataFrame, small: list[_Rank]) -> None:
    """Distinct values (with counts) strictly inside the brackets of ranks that have few rows left."""
    held = F.array(*[F.when(r.between(), F.struct(F.lit(k).alias("k"), F.col(r.col).cast("double").alias("v")))
                     for k, r in enumerate(small)])
    # outer: else Catalyst pushes a filter on the whole array expression down
    rows = (df.select(F.explode_outer(F.filter(held, lambda x: x.isNotNull())).alias("x")).where("x is not null")
            .groupBy("x.k", "x.v").count().collect())
    by: dict[int, list] = {}
    for k, v, n in sorted((r["k"], r["v"], r["count"]) for r in rows):
        by.setdefault(k, []).append((v, n))
    for k, r in enumerate(small):
        at = r.rank - r.below
        for v, n in by[k]:
            if at < n:
                r.value = v
                break
            at -= n


def exact_quantiles(df: DataFrame, spec: Mapping[str, Sequence[float]], max_bracket: int = 1024, accuracy: int = 20_000,
                    extra_aggs: Sequence = (), extra_out: dict | None = None) -> dict[str, list[float | None]]:
    """Return ``{column: [quantile value per q]}``; ``None`` for an all-null column.

    Nulls are ignored (as in pandas).  One path at all sizes: a count pass, at
    least one narrowing round of two passes, a pass that reads the values left
    and one for the values to interpolate with; every pass serves all columns and is a plain aggregate.  A round leaves
    about ``8 / accuracy`` of the rows it starts with, whatever values repeat, so
    the rounds grow with the logarithm of the rows.  At most ``max_bracket``
    values of a rank reach the driver.  ``extra_aggs`` (bounded aggregates of the
    caller) ride along in the first pass; their values are put in ``extra_out``.
    """
    cols = list(spec)
    counts = df.agg(F.count(F.lit(1)), *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)], *extra_aggs).first()
    if extra_out is not None:
        extra_out.update(counts.asDict())
    ranks: dict[tuple[str, int], _Rank] = {}
    for i, c in enumerate(cols):
        n = int(counts[f"n{i}"])
        for q in spec[c] if n else ():
            r = math.floor((n - 1) * float(q))
            ranks.setdefault((c, r), _Rank(c, r, n))
    todo, first = list(ranks.values()), True
    while todo:
        large = [r for r in todo if first or r.inside > max_bracket]
        small = [r for r in todo if not first and r.inside <= max_bracket]
        if small:
            _read(df, small)
        if large:
            _narrow(df, large, accuracy)
        todo, first = [r for r in todo if r.value is None], False
    after = _following(df, [(c, r) for (c, r) in ranks if any((counts[f"n{cols.index(c)}"] - 1) * float(q) % 1 for q in spec[c])], ranks)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        n = int(counts[f"n{i}"])
        out[c] = []
        for q in spec[c]:
            h = (n - 1) * float(q)
            a = ranks[c, math.floor(h)].value if n else None
            out[c].append(a if not n or h == math.floor(h) else a + (after[c, math.floor(h)] - a) * (h - math.floor(h)))
    return out


def _following(df: DataFrame, wanted: list[tuple[str, int]], ranks: dict[tuple[str, int], _Rank]) -> dict[tuple[str, int], float]:
    """The value one rank further on, in one pass: the same value while rows of it are left, else the next larger one."""
    if not wanted:
        return {}
    asks = []
    for k, (c, r) in enumerate(wanted):
        x, v = F.col(c), F.lit(ranks[c, r].value)
        asks += [F.count_if(x <= v).alias(f"n{k}"), F.min(F.when(x > v, x)).alias(f"v{k}")]
    got = df.agg(*asks).first()
    return {(c, r): ranks[c, r].value if r + 1 < got[f"n{k}"] or got[f"v{k}"] is None else float(got[f"v{k}"])
            for k, (c, r) in enumerate(wanted)}


def approx_quantiles(df: DataFrame, spec: Mapping[str, Sequence[float]],
                     accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """One pass of ``percentile_approx`` per column (bounded memory, rank error 1/accuracy)."""
    cols = list(spec)
    row = df.agg(*[F.percentile_approx(F.col(c), F.array(*[F.lit(float(q)) for q in spec[c]]),
                                       accuracy).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return {c: ([float(v) for v in row[f"q{i}"]] if row[f"q{i}"] is not None else [None] * len(spec[c]))
            for i, c in enumerate(cols)}


def quantiles(df: DataFrame, spec: Mapping[str, Sequence[float]], method: str = "exact",
              **kw) -> dict[str, list[float | None]]:
    if method == "exact":
        return exact_quantiles(df, spec, **kw)
    if method == "approx":
        return approx_quantiles(df, spec, **kw)
    raise ValueError(f"unknown quantile method {method!r}")
