"""Filter interaction audit: what each order of five text filters keeps, removes and repeats.

A byte transducer given by two tables reads every text once; its outputs count
words, capitals, code points and symbols, and its word spans go into a hash
table that compares the spans' bytes before it calls two words equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.heavy import heavy_split_join
from churnkit.llm.common import as_bytes, batch, materialise, slices, text_of

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
MIN_WORDS = 200
MIN_DISTINCT = 50   # percent of the words
MAX_CAPITALS = 3    # percent of the code points

# byte classes
SPACE, CAPITAL, SYMBOL, PLAIN, LEAD, INNER, END = range(7)
# outputs of a transition, one bit each
BEGIN, STOP, POINT, UPPER, MARK = 1, 2, 4, 8, 16
#: texts are read a few at a time, so that the tables of one pass stay near this many bytes
CHUNK = 1 << 20
#: words longer than this are told apart by a Python set
LONG = 256


def _classes() -> np.ndarray:
    """The class of each byte; END is a byte that UTF-8 never has and that closes each text."""
    c = np.full(256, PLAIN, np.uint8)
    c[0x80:0xC0] = INNER
    c[0xC0:0xFF] = LEAD
    c[0xFF] = END
    c[[0x20, *range(0x09, 0x0E)]] = SPACE
    c[ord("A"):ord("Z") + 1] = CAPITAL
    c[list(SYMBOLS)] = SYMBOL
    return c


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state by class, outputs by state and class); state 1 is inside a word."""
    inside = np.ones(8, np.uint8)
    inside[[SPACE, END]] = 0
    out = np.zeros((2, 8), np.uint8)
    for state in (0, 1):
        for c in range(7):
            o = 0 if c in (INNER, END) else POINT
            if inside[c] and not state:
                o |= BEGIN
            if state and not inside[c]:
                o |= STOP
            o |= {CAPITAL: UPPER, SYMBOL: MARK}.get(c, 0)
            out[state, c] = o
    return inside, out.ravel()


CLASS = _classes()
INSIDE, OUTPUT = _transitions()
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


class _Spans:
    """The word spans of one buffer: eight bytes at a time as numbers, their hashes, and equality of their bytes."""

    def __init__(self, buf: bytes, start: np.ndarray, length: np.ndarray, owner: np.ndarray):
        self.start, self.length, self.owner = start, length, owner
        self.eights = np.ndarray(len(buf) - 8, "<u8", buf, strides=(1,))  # one number at every byte; the buffer ends in 8 zeros
        self.first = self.part(np.arange(len(start)), 0)
        h = (self.first ^ owner.astype(np.uint64) * _MIX2) * _MIX
        at, more = 8, np.flatnonzero(length > 8)
        while more.size:
            x = h[more]
            h[more] = ((x ^ (x >> np.uint64(29))) * _MIX2 ^ self.part(more, at)) * _MIX
            at += 8
            more = more[length[more] > at]
        self.hash = (h ^ (h >> np.uint64(32))) * _MIX

    def part(self, which: np.ndarray, at: int) -> np.ndarray:
        left = np.minimum(self.length[which] - at, 8)
        return self.eights[self.start[which] + at] & _MASKS[left]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a and b are of the same text and hold the same bytes."""
        same = (self.hash[a] == self.hash[b]) & (self.owner[a] == self.owner[b]) & \
            (self.length[a] == self.length[b]) & (self.first[a] == self.first[b])
        at, open_ = 8, np.flatnonzero(same & (self.length[a] > 8))
        while open_.size:
            ok = self.part(a[open_], at) == self.part(b[open_], at)
            same[open_[~ok]] = False
            at += 8
            open_ = open_[ok]
            open_ = open_[self.length[a[open_]] > at]
        return same

    def distinct(self) -> np.ndarray:
        """One span of each distinct word of each text, by insertion of all spans into an open-addressing table."""
        n = len(self.start)
        bits = max(4, int(2 * n).bit_length())
        table = np.full(1 << bits, -1, np.int32)
        slot = (self.hash >> np.uint64(64 - bits)).astype(np.int64)
        todo, new = np.arange(n, dtype=np.int32), []
        while todo.size:
            at = slot[todo]
            free = table[at] < 0
            table[at[free]] = todo[free]
            held = table[at]
            mine = held == todo
            new.append(todo[mine])
            rest = np.flatnonzero(~mine)
            rest = rest[~self.equal(todo[rest], held[rest])]
            todo = todo[rest]
            slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
        return np.concatenate(new) if new else np.empty(0, np.int32)


def measure(texts: list[bytes]) -> np.ndarray:
    """Columns n_words, n_distinct, n_capitals, n_points, n_symbols of each text (whole, UTF-8)."""
    n = len(texts)
    out = np.zeros((5, n), np.int64)
    if not n:
        return out
    joined = b"\xff".join([*texts, b"\0" * 8])
    raw = np.frombuffer(joined, np.uint8)[:-8]
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) + 1 for t in texts]
    cls = CLASS[raw]
    state = np.zeros(len(raw), np.uint8)
    state[1:] = INSIDE[cls[:-1]]
    act = OUTPUT[(state << 3) | cls]
    del cls, state
    begin, stop = np.flatnonzero(act & BEGIN), np.flatnonzero(act & STOP)
    out[3] = np.add.reduceat((act & POINT) >> 2, starts, dtype=np.int64)

    def by_text(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(ends, at, "right")

    out[2] = np.bincount(by_text(np.flatnonzero(act & UPPER)), minlength=n)
    out[4] = np.bincount(by_text(np.flatnonzero(act & MARK)), minlength=n)
    owner, length = by_text(begin), stop - begin
    out[0] = np.bincount(owner, minlength=n)
    short = length <= LONG
    spans = _Spans(joined, begin[short], length[short], owner[short])
    out[1] = np.bincount(spans.owner[spans.distinct()], minlength=n)
    for d, _ in {(int(d), joined[s:s + k]) for d, s, k in zip(owner[~short], begin[~short], length[~short])}:
        out[1][d] += 1
    return out


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, n_words, n_distinct, n_capitals, n_points, n_symbols, sha): one row per input row, null text empty, null part ''."""
    schema = pa.schema([("id", pa.int64()), ("part", pa.string()), *[(c, pa.int64()) for c in MEASURES], ("sha", pa.binary())])

    def few(part: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
        """Rows of about CHUNK bytes of text (a longer text alone)."""
        texts, size, at = as_bytes(part.column("text")), 0, 0
        for k, t in enumerate(texts):
            if size and size + len(t) > CHUNK:
                yield at, texts[at:k]
                at, size = k, 0
            size += len(t) + 1
        yield at, texts[at:]

    def run(batches):
        for part in slices(batches):
            for at, texts in few(part):
                if texts:
                    yield batch(schema, part.column("id").slice(at, len(texts)), part.column("part").slice(at, len(texts)).cast(pa.string()),
                                *measure(texts), [hashlib.sha256(t).digest() for t in texts])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(part_col).alias("part"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, part string, " + ", ".join(f"{c} long" for c in MEASURES) + ", sha binary")


MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def failures(measured: DataFrame) -> DataFrame:
    """(id, part, mask, n): the filters that a row fails, a bit each in the order of FILTERS, and how many input rows are alike.

    Filter E fails a row whose text a smaller id has: only texts that occur under
    several ids are joined back, and a text with a large share of the rows is split
    over several tasks.  A null id is not greater than any.
    """
    own = [F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"),
           100 * F.col("n_capitals") > MAX_CAPITALS * F.col("n_points"), F.col("n_symbols") > 0]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(own)), F.lit(0))
    # rows that repeat are counted before anything is joined, so no id or text brings more rows than it has cells
    rows = materialise(measured.groupBy("id", "part", mask.cast("int").alias("mask"), "sha").agg(F.count(F.lit(1)).alias("n")), "audited")
    first = rows.groupBy("sha").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("sha", "low")
    later = F.coalesce(F.col("id") > F.col("low"), F.lit(False))
    return heavy_split_join(rows, first, "sha", ["id", "part", "mask"], "left").groupBy(
        "id", "part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).alias("mask")).agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Every row of ``docs`` counts, repeated ones as often as they occur; null text
    is empty, a null part is '', a row of null id is unlabelled and never a later
    copy.  ``labels`` (id, quality, toxic) may lack ids, repeat them (any 1
    counts) or hold nulls.  Other columns are not read.  An empty table has no
    parts and gives no rows.

    All counts depend only on the set of filters that ran before, so they are
    summed over the 80 pairs of such a set and a filter, and each order's steps
    look their pair up.
    """
    spark = docs.sparkSession
    fails = materialise(failures(signals(docs, id_col, text_col, part_col)), "fails")
    marked = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = fails.where("id is not null").join(marked, "id", "left")
    rows = known.unionByName(fails.where("id is null"), allowMissingColumns=True)
    cells = rows.groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))

    steps = [(ran, k) for ran in range(1 << len(FILTERS)) for k in range(len(FILTERS)) if not ran >> k & 1]
    pairs = F.explode(F.array(*[F.lit(ran * 8 + k) for ran, k in steps])).alias("pair")  # 80 numbers
    ran, bit = F.floor(F.col("pair") / 8).cast("int"), F.expr("shiftleft(1, cast(pair % 8 as int))")
    passed = F.col("mask").bitwiseAND(ran) == 0
    fails_it = F.col("mask").bitwiseAND(bit) != 0

    def total(when, by=F.lit(1)):
        return F.sum(F.when(when, F.col("n") * by).otherwise(0)).cast("long")

    by_pair = cells.select("*", pairs).groupBy("part", "pair").agg(
        total(passed & ~fails_it).alias("kept"), total(passed & fails_it).alias("removed"), total(~passed & fails_it).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"), total(passed & fails_it, F.col("good")).alias("good_lost"),
        total(passed & fails_it, F.col("toxic")).alias("toxic_lost"))
    # how many orders have a filter right after such a set
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), F.bit_count(ran) + 1)
    by_filter = by_pair.groupBy("part", (F.col("pair") % 8).alias("k")).agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))

    plan = []
    for p in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(p, 1):
            plan.append(("".join(FILTERS[x] for x in p), step, before * 8 + k, k))
            before |= 1 << k
    steps_of = spark.createDataFrame(plan, "filter_order string, step int, pair int, k int")  # 120 orders x 5 steps
    return by_pair.join(F.broadcast(steps_of), "pair").join(by_filter, ["part", "k"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
