"""First-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import batch, materialise, slices, text_of
from churnkit.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
GROUP = 8192  # pieces a group holds on average
END = (1).to_bytes(4, "little")


class Tournament:
    """Bin capacities in a complete binary tree whose nodes hold the largest room below."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(first bin with room, room it had); its room shrinks by ``size``."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        had = tree[at]
        tree[at] = had - size
        leaf, at = at - self.leaves, at // 2
        while at:
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
        return leaf, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size; sizes are placed largest first, ties in the order given."""
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    tree = Tournament(max(1, len(sizes)), capacity)
    for k in np.argsort(-sizes, kind="stable"):
        b, room = tree.place(int(sizes[k]))
        bins[k], offsets[k] = b, capacity - room
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Each document's ids (and an end id) cut at multiples of ``capacity``: id, start, length, ids_crc32, doc_tokens."""
    out = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("again", pa.int64())])

    def run(batches):
        enc, seen = encoder(tokenizer), Counter()  # rows that repeat id and content are numbered, to spread them
        for part in slices(batches):
            seen.clear()
            rows = []
            for i, ids in zip(part.column("id").to_pylist(), enc.encode(part.column("text").to_pylist())):
                raw = ids + END
                n = len(raw) // 4
                cut = [(s, min(capacity, n - s), zlib.crc32(raw[4 * s:4 * (s + capacity)])) for s in range(0, n, capacity)]
                again = seen[i, n, cut[0][2]]
                seen[i, n, cut[0][2]] += 1
                rows += [(i, *c, n, again) for c in cut]
            yield batch(out, *zip(*rows))

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(
        run, "id long, start long, length long, ids_crc32 long, doc_tokens long, again long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, seed: int = 7, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with id 1 and are cut at multiples of ``capacity``;
    pieces are dealt to groups by a seeded hash and every group is packed alone,
    largest piece first into the first sequence with room.  Null text counts as
    empty (one piece, the end id); a null id stays null; repeated rows are packed
    each on its own.  An empty table gives an empty result; other columns are not
    read.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer or tokenizer_path(), capacity, id_col, text_col)
    cut = materialise(cut.withColumn("deal", F.xxhash64("id", "start", "ids_crc32", "doc_tokens", "again", F.lit(seed))), "pieces")
    groups = max(1, -(-cut.count() // GROUP))
    dealt = cut.withColumn("grp", F.pmod(F.col("deal"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "deal", "id", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = pdf["grp"] * (1 << 32) + bins
        pdf["offset"] = offsets
        return pdf[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    packed = dealt.groupBy("grp").applyInPandas(
        run, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col) if id_col != "id" else packed
