"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is mapped to 32 counts, the set bits of each 2-bit
segment.  The Manhattan distance of two such vectors is never more than the
Hamming distance of the fingerprints, so it is a lower bound that prunes.  The
32 dimensions are dealt to ``max_bits // 2 + 1`` blocks; fingerprints at
``max_bits`` or fewer differ by at most 1 (Manhattan) in one block at least.
Each block is a grid of unit cells: a fingerprint lies in its own cell and
probes the cells one step up in one dimension (a pair one step apart meets in
the upper cell).  What meets in a cell is verified by exact Hamming distance.

Exact copies and equal fingerprints are one node from the start.  A cell with
more than ``TILE`` fingerprints is cut in tiles of a bounded size that together
compare every pair; a tile returns a spanning forest where links are dense, so
a large group of near copies never becomes all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import as_bytes, batch, fresh, materialise, partitions, text_of, whole
from churnkit.llm.graph import components

TILE = 4096
STEP = 1 << 15  # shingles hashed at once: bounds memory for very long texts
ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash: bit set if in over half the shingle hashes; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1:] - 1).tolist()
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), STEP):
        part = np.array([h(joined[a:b], 42) for a, b in zip(starts[at:at + STEP], stops[at:at + STEP])], dtype=np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, text_hash, fp): fp is the fingerprint as a signed long, text_hash tells rows of one id apart."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"),
                      text_of(text_col).alias("text"))
    out = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(b.column("text"))], dtype=np.uint64)
            yield batch(out, b.column("id"), b.column("text_hash"), fps.view(np.int64))

    return src.mapInArrow(run, "id long, text_hash long, fp long")


def _blocks(max_bits: int) -> list[list[int]]:
    n = max_bits // 2 + 1
    return [list(range(b, 32, n)) for b in range(n)]


def cells_of(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint, probe) rows of the grid for an array of fingerprints."""
    mask = np.uint64(0x5555555555555555)
    counts = fp - ((fp >> np.uint64(1)) & mask)  # 2-bit fields, each the popcount of its segment
    cell, at, probe, index = [], [], [], np.arange(len(fp))
    for b, dims in enumerate(_blocks(max_bits)):
        own = counts & np.uint64(sum(3 << (2 * d) for d in dims))
        salt = np.uint64(b * 0xC2B2AE3D27D4EB4F & (2**64 - 1))
        cell.append(own * ODD + salt)
        at.append(index)
        probe.append(np.zeros(len(fp), dtype=bool))
        for d in dims if max_bits else []:
            up = ((own >> np.uint64(2 * d)) & np.uint64(3)) < 2
            cell.append((own[up] + np.uint64(1 << (2 * d))) * ODD + salt)
            at.append(index[up])
            probe.append(np.ones(int(up.sum()), dtype=bool))
    return np.concatenate(cell), np.concatenate(at), np.concatenate(probe)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) among n items as a star to the smallest item of each component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def links_in_cell(home: np.ndarray, other: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct fingerprints at ``max_bits`` or fewer, as a forest where they are dense."""
    items = np.concatenate([home, other])
    found_i, found_j, kept = [], [], 0
    step = max(1, (1 << 20) // len(other))
    for at in range(0, len(home), step):
        x = home[at:at + step, None] ^ other[None, :]
        i, j = np.nonzero(np.bitwise_count(x) <= max_bits)
        real = x[i, j] != 0
        found_i.append(i[real] + at)
        found_j.append(j[real] + len(home))
        kept += int(real.sum())
        if kept > 4 * len(items):
            i, j = forest(len(items), np.concatenate(found_i), np.concatenate(found_j))
            found_i, found_j, kept = [i], [j], len(i)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    return items[i], items[j]


def links(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly what is within ``max_bits``."""
    spark = nodes.sparkSession
    out = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("probe", pa.bool_())])

    def grid(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 8192):
                part = fp[at:at + 8192]
                cell, index, probe = cells_of(part, max_bits)
                yield batch(out, cell.view(np.int64), part[index].view(np.int64), probe)

    rows = nodes.select("fp").mapInArrow(grid, "cell long, fp long, probe boolean")
    # cells of many fingerprints: how many tiles their home rows and all their rows are cut in
    hot = materialise(rows.groupBy("cell").agg(F.count_if(~F.col("probe")).alias("h"), F.count(F.lit(1)).alias("o"))
                      .where(f"h > 0 and o > {TILE}")
                      .select("cell", F.ceil(F.col("h") / TILE).cast("int").alias("nh"),
                              F.ceil(F.col("o") / TILE).cast("int").alias("no")), "hot-cells")
    dealt = rows.join(hot, "cell", "left").withColumn("deal", F.xxhash64("fp", "probe"))
    own = lambda n: F.pmod("deal", F.coalesce(F.col(n), F.lit(1))).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    as_home = dealt.where("not probe").select("cell", own("nh").alias("r"), upto("no").alias("s"), "fp", F.lit(True).alias("home"))
    as_other = dealt.select("cell", upto("nh").alias("r"), own("no").alias("s"), "fp", F.lit(False).alias("home"))
    tiles = as_home.union(as_other).select(F.xxhash64("cell", "r", "s").alias("tile"), "fp", "home") \
        .repartition(partitions(spark), "tile")
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches):
        rows = whole(batches, ["tile", "fp", "home"])
        if not len(rows["tile"]):
            return
        order = np.lexsort((~rows["home"].astype(bool), rows["tile"]))
        tile, fp, home = rows["tile"][order], rows["fp"][order].view(np.uint64), rows["home"][order].astype(bool)
        start = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        n, h = np.diff(np.r_[start, len(tile)]), np.add.reduceat(home.astype(np.int64), start)
        a, b = [], []
        for k in np.flatnonzero((h > 0) & (n - h > 1)):
            s, e, m = start[k], start[k] + n[k], start[k] + h[k]
            x, y = links_in_cell(fp[s:m], fp[m:e], max_bits)
            if len(x):
                x, y = x.view(np.int64), y.view(np.int64)
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
        if a:
            found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            for at in range(0, len(found), 1 << 16):
                yield batch(pairs, found[at:at + (1 << 16), 0], found[at:at + (1 << 16), 1])

    return tiles.mapInArrow(verify, "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                  max_bits: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, text_hash.

    component_id is the smallest id reachable by links of ``max_bits`` or
    fewer, itself included.  Null text counts as empty (fingerprint zero,
    linked like any other); a null id stays null and its component_id is the
    smallest id that is not null, or null if there is none.  Repeated rows
    come out repeatedly.  An empty table gives an empty result.  Other columns
    are not read.
    """
    spark = docs.sparkSession
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    cc = components(links(nodes, max_bits))
    members = materialise(nodes.join(cc, nodes.fp == cc.node).select("fp", "root", "low"), "members")
    smallest = materialise(members.groupBy("root").agg(F.min("low").alias("component")), "smallest")
    linked = members.join(smallest, "root").select("fp", "component")
    comp = materialise(nodes.join(linked, "fp", "left").select("fp", F.when(F.col("component").isNull(), F.col("low"))
                                                               .otherwise(F.col("component")).alias("component")), "components")
    return rows.join(comp, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"), "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the smallest id (then the smallest text hash; rows that
    repeat both are copies of one row and one of them stays)."""
    sid, shash = fresh(docs, "stay_id", "stay_hash")
    found = simhash_dedup(docs, id_col, text_col, shingle, max_bits)
    found = found.withColumn("component_key", F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint")))
    first = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("text_hash").alias("h"))).alias("k")
    stay = materialise(found.groupBy("component_key").agg(first).select(F.col("k.i").alias(sid), F.col("k.h").alias(shash)).distinct(), "stay")
    key = F.col(id_col).cast("long").eqNullSafe(F.col(sid)) & (F.xxhash64(text_of(text_col)) == F.col(shash))
    kept = docs.join(stay, key, "left_semi")
    again = materialise(found.groupBy(F.col(id_col).alias(sid), F.col("text_hash").alias(shash)).count().where("count > 1").drop("count"), "repeated")
    if again.isEmpty():
        return kept
    return kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([id_col, text_col]))
