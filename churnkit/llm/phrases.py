"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed bottom up.  On each level runs of one symbol
are named first, so neighbours differ; then deterministic coin tossing labels a
symbol by the lowest bit in which it differs from its left neighbour and that
bit's value, again and again until labels are below 6 and neighbours still
differ; a phrase starts wherever the label is a local maximum.  Whether a
position starts a phrase hangs on a few symbols around it only, so equal
substrings are cut alike wherever they stand, but for their ends.  A phrase is
named by a hash of its symbols, and the names are the next level's symbols.

The fingerprint is a min-hash sketch of the names of levels 2 and up (level 1
too where there are few), ``BINS`` 16-bit values in hexadecimal.  Likeness of
two fingerprints is the share of common phrases, 2m / (1 + m) for a share m of
equal values.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import batch, partitions, text_of

BINS = 64
FEW = 32  # phrases of level 2 and up below which level 1 is added
CHUNK = 1 << 19  # bytes of text parsed at once in a task
EMPTY = np.uint16(0xFFFF)


def _toss(prev: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Label of each symbol against its (different) left neighbour: 2 * (lowest differing bit) + own bit."""
    diff = prev ^ own
    low = np.bitwise_count((diff & (~diff + diff.dtype.type(1))) - diff.dtype.type(1)).astype(np.uint8)
    return (2 * low + ((own >> low.astype(own.dtype)) & own.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


_B = np.arange(256, dtype=np.uint16)
#: label of a byte (column) after a byte (row); equal neighbours don't occur
BYTE_TOSS = _toss(np.repeat(_B, 256), np.tile(_B, 256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of whole arrays (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _lookup(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    pair = np.empty(len(labels), dtype=np.int32)
    pair[0], pair[1:] = 0, labels[:-1].astype(np.int32) << 8
    pair += labels
    out = BYTE_TOSS[pair]
    out[first] = labels[first] & 1
    return out


def parse(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: symbols and the number of the text each stands in -> names of phrases and their texts."""
    # runs of a symbol become one symbol
    new_text = np.r_[True, text[1:] != text[:-1]]
    start = np.flatnonzero(new_text | np.r_[True, names[1:] != names[:-1]])
    if len(start) < len(names):
        length = np.diff(np.r_[start, len(names)])
        names, text, new_text = names[start], text[start], new_text[start]
        many = length > 1
        if names.dtype == np.uint8:
            wide = names.astype(np.uint64)
            wide[many] = mixed(wide[many] + np.uint64(0x100) * length[many].astype(np.uint64))
            labels_from = wide
        else:
            names = names.copy()
            names[many] = mixed(names[many] + length[many].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            labels_from = names
    else:
        labels_from = names
    first = np.flatnonzero(new_text)
    if names.dtype == np.uint8:  # neighbours differ as bytes also where runs were named
        labels, names = _lookup(names, first), labels_from.astype(np.uint64)
    else:
        labels = np.empty(len(names), dtype=np.uint8)
        labels[1:] = _toss(names[:-1], names[1:])
        labels[first] = (names[first] & np.uint64(1)).astype(np.uint8)
    for _ in range(3):  # below 128, 14, 8, 6
        labels = _lookup(labels, first)
    peak = np.zeros(len(labels), dtype=bool)
    peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    peak[first[1:] - 1] = False  # the last symbol of a text starts no phrase
    peak[first] = True
    begin = np.flatnonzero(peak)
    place = np.arange(len(names)) - np.repeat(begin, np.diff(np.r_[begin, len(names)]))
    parts = mixed(names + PLACE[np.minimum(place, len(PLACE) - 1)])
    return mixed(np.add.reduceat(parts, begin)), text[begin]


PLACE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signatures(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, number of the text) of the phrases of each level, from level 1 up."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    names = np.frombuffer(b"".join(texts), dtype=np.uint8)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    levels = []
    while len(names):
        names, text = parse(names, text)
        levels.append((names, text))
        more = (np.bincount(text, minlength=len(texts)) > 1)[text]  # a text of one phrase is done
        names, text = names[more], text[more]
    return levels


def sketches(texts: list[bytes]) -> np.ndarray:
    """[text, bin] 16-bit min-hash sketches; a text without phrases (an empty one) has EMPTY everywhere."""
    n = len(texts)
    levels = signatures(texts)
    low = np.full(n * BINS, np.uint64(2**64 - 1))
    count = np.zeros(n, dtype=np.int64)
    for names, text in levels[1:]:
        count += np.bincount(text, minlength=n)
    for k, (names, text) in enumerate(levels):
        if k == 0:
            few = (count < FEW)[text]
            names, text = names[few], text[few]
        h = mixed(names + np.uint64(k))
        np.minimum.at(low, text.astype(np.int64) * BINS + (h >> np.uint64(58)).astype(np.int64), h & np.uint64((1 << 58) - 1))
    low = low.reshape(n, BINS)
    filled = low != np.uint64(2**64 - 1)
    out = (mixed(low) % np.uint64(0xFFFF)).astype(np.uint16)
    # an empty bin takes the next filled one's value, altered by the distance
    some = filled.any(1)
    at, dist = np.tile(np.arange(BINS), (n, 1)), np.zeros((n, BINS), dtype=np.int64)
    rows = np.arange(n)[:, None]
    for _ in range(BINS):
        need = ~filled[rows, at] & some[:, None]
        if not need.any():
            break
        at, dist = np.where(need, (at + 1) % BINS, at), dist + need
    out = ((out[rows, at].astype(np.int64) + 7919 * dist) % 0xFFFF).astype(np.uint16)
    out[~some] = EMPTY
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = (a == b).mean(axis=-1)
    return 2 * m / (1 + m)


def hexed(sketch: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sketch]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint.  Null text counts as empty (all values 'ffff')."""
    out = pa.schema([("id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            ids = b.column("id")
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                yield batch(out, ids.slice(at, end - at), hexed(sketches(texts[at:end])))
                at = end

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")) \
        .mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document is compared with its edited text and with the next document in
    ascending id (null ids last, ties by a hash of the text; the first follows the
    last).  Documents are dealt to ranges of ids; each range is sorted and read
    in order, and borrows the first document of the range after it, so texts are
    shuffled once.  Null text counts as empty; repeated rows follow each other; an
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")) \
        .withColumn("h", F.xxhash64("text"))
    parts = partitions(spark)
    shares = [k / (4 * parts) for k in range(1, 4 * parts)]
    bounds = base.agg(F.percentile_approx("id", shares, 100_000)).first()[0] or []
    # the range of an id: count the bounds at or below it, in two steps over a square-root tree
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k:k + width] for k in range(0, len(bounds), width)]

    def below(values: F.Column, x: F.Column) -> F.Column:
        return F.size(F.filter(values, lambda v: v <= x))

    if groups:
        heads_of = F.array(*[F.lit(g[0]).cast("long") for g in groups])
        nested = F.array(*[F.array(*[F.lit(v).cast("long") for v in g]) for g in groups])
        coarse = below(heads_of, F.col("id"))
        ranged = base.withColumn("coarse", coarse).withColumn("range", F.when(F.col("id").isNull(), len(bounds) + 1).when(
            F.col("coarse") == 0, 0).otherwise((F.col("coarse") - 1) * width + below(F.element_at(nested, F.greatest("coarse", F.lit(1))), F.col("id")))).drop("coarse")
    else:
        ranged = base.withColumn("range", F.when(F.col("id").isNull(), 1).otherwise(0))
    order = F.struct(F.col("id").isNull().alias("n"), "id", "h")
    heads = sorted(ranged.groupBy("range").agg(F.min(order).alias("o")).select("range", "o.id", "o.h").collect())  # a row per range
    borrow = [(a[0], b[1], b[2]) for a, b in zip(heads, heads[1:] + heads[:1])]
    lent = F.broadcast(spark.createDataFrame(borrow, "range int, head long, hh long"))
    borrowed = base.join(lent, F.col("id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("hh"))).select("id", "text", "h", "range", F.lit(False).alias("own"))
    rows = ranged.select("id", "text", "h", F.col("range").cast("int"), F.lit(True).alias("own")).unionByName(borrowed)
    rows = rows.repartition(parts, "range").sortWithinPartitions("range", F.col("own").desc(), F.col("id").asc_nulls_last(), "h") \
        .select("id", "text", "range", "own")
    out = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def followed(batches):
        """(id, text, following text) of the documents of each range, in order."""
        last = None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for i, text, r, own in zip(*(part.column(c).to_pylist() for c in ("id", "text", "range", "own"))):
                    if last is not None and last[2] == r:
                        yield last[0], last[1], text
                    last = (i, text, r) if own else None

    def run(batches):
        held, size = [], 0

        def flush():
            n = len(held)
            changed = [edited(t, f) for _, t, f in held]
            raw = [t.encode() for t in changed]
            # the documents follow each other but for the ends of ranges
            texts, at, nxt = [], [], []
            for k, (_, t, f) in enumerate(held):
                at.append(len(texts))
                texts.append(t.encode())
                if k + 1 < n and held[k + 1][1] is f:
                    nxt.append(len(texts))
                else:
                    nxt.append(len(texts))
                    texts.append(f.encode())
            s = sketches(texts + raw)
            own, other, after = s[at], s[len(texts):], s[nxt]
            return batch(out, [i for i, _, _ in held], [len(t) for _, t, _ in held], [hashlib.sha256(r).hexdigest() for r in raw],
                         hexed(own), hexed(other), likeness(own, other), likeness(own, after))

        for row in followed(batches):
            held.append(row)
            size += len(row[1])
            if size > CHUNK // 4:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    found = rows.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                            "near_edited double, near_next double")
    return found.withColumnRenamed("id", id_col)
