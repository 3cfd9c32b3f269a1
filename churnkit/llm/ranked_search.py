"""Ranked lexical search for many items at once, with common subexpressions evaluated once.

The score of a document for an item is a sum over the item's terms.  Sets of
terms that several items share are mined before any document is read; each
becomes a node of a graph whose inner nodes add two others.  A batch of documents
gets one accumulator per node, computed once from those below it, and each item
adds up the few nodes that cover its terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnkit.llm.common import as_bytes, batch, materialise, slices, text_of

#: bytes that a term can't hold, as a table that makes them spaces and A-Z small
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if _TERM.match(bytes([b])) else 32 for b in range(256))
#: items and characters of item text that one pass over the documents serves at most
BLOCK_ITEMS = 2048
BLOCK_CHARS = 1 << 24
#: of an item's shared nodes, ordered by how many items hold them, pairs are looked for within runs of this length
RUN = 64
#: numbers that the accumulators of one batch of documents hold
CELLS = 1 << 21
#: the final ranking is made in so many parts of an item first
PARTS = 64


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


# ---------------------------------------------------------------- mining
@dataclass
class Sharing:
    """The graph: leaf of each term, (node, left, right) levels, and each item's nodes."""

    leaf: np.ndarray           # term -> leaf
    n_nodes: int
    levels: list[np.ndarray]   # rows (node, left, right); a level needs only earlier ones
    item_nodes: list[list[int]]
    plain_adds: int            # additions that separate items would take for a document
    adds: int                  # additions that the graph takes


def mine(items: list[list[int]], n_terms: int) -> Sharing:
    """Shared term sets of ``items`` (lists of distinct term numbers).

    Terms that the same items hold become one leaf.  Then, round by round, pairs
    of nodes that at least two items still hold become one node, the most shared
    first, until no pair is shared.  Pairs are counted within runs of ``RUN``
    nodes of an item, in the order of how many items hold them, so mining is
    linear in the items' length; what it misses costs additions, not results.
    """
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for k, terms in enumerate(items):
        for t in terms:
            holders[t].append(k)
    leaves: dict[tuple[int, ...], int] = {}
    leaf = np.array([leaves.setdefault(tuple(h), len(leaves)) for h in holders], np.int64)
    nodes = [sorted({int(leaf[t]) for t in terms}) for terms in items]
    count = Counter(x for have in nodes for x in have)
    n, depth, inner = len(leaves), defaultdict(int), []
    while True:
        pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, have in enumerate(nodes):
            shared = sorted((x for x in have if count[x] > 1), key=lambda x: (-count[x], x))
            for at in range(0, len(shared), RUN):
                run = sorted(shared[at:at + RUN])
                for i, a in enumerate(run):
                    for b in run[i + 1:]:
                        pairs[a, b].append(k)
        found = False
        held = [set(x) for x in nodes]
        for (a, b), who in sorted(pairs.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(who) < 2:
                break
            who = [k for k in who if a in held[k] and b in held[k]]
            if len(who) < 2:
                continue
            found = True
            depth[n] = max(depth[a], depth[b]) + 1
            inner.append((n, a, b))
            for k in who:
                held[k] -= {a, b}
                held[k].add(n)
            count[a] -= len(who)
            count[b] -= len(who)
            count[n] = len(who)
            n += 1
        nodes = [sorted(x) for x in held]
        if not found:
            break
    levels: dict[int, list] = defaultdict(list)
    for row in inner:
        levels[depth[row[0]]].append(row)
    plain = sum(max(0, len(t) - 1) for t in items)
    # terms of one leaf are added as they are read
    adds = len(inner) + sum(max(0, len(x) - 1) for x in nodes) + sum(1 for h in holders if h) - len(leaves) + (1 if () in leaves else 0)
    return Sharing(leaf, n, [np.array(levels[d], np.int64) for d in sorted(levels)], nodes, plain, adds)


def accumulate(s: Sharing, values: np.ndarray, term: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Item scores (items x documents) of one batch: every node's accumulator once, then the items' sums."""
    nodes = np.zeros((s.n_nodes, n_docs), np.int64)
    np.add.at(nodes, (s.leaf[term], doc), values)
    for level in s.levels:
        nodes[level[:, 0]] = nodes[level[:, 1]] + nodes[level[:, 2]]
    out = np.zeros((len(s.item_nodes), n_docs), np.int64)
    some = [k for k, x in enumerate(s.item_nodes) if x]
    if some:
        starts = np.cumsum([0, *[len(s.item_nodes[k]) for k in some[:-1]]])
        out[some] = np.add.reduceat(nodes[np.concatenate([s.item_nodes[k] for k in some])], starts, axis=0)
    return out


# ---------------------------------------------------------------- corpus
def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms array<int>, tfs array<int>): every row's number of terms and its counts of the vocabulary's terms.

    The vocabulary is that of one block of items, so its size is bounded; it goes to the tasks in a broadcast variable.
    """
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def lists(rows: list[Counter]) -> tuple[pa.Array, pa.Array]:
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        keys = np.fromiter((k for r in rows for k in r), np.int32, ends[-1])
        values = np.fromiter((v for r in rows for v in r.values()), np.int32, ends[-1])
        return pa.ListArray.from_arrays(ends, keys), pa.ListArray.from_arrays(ends, values)

    def run(batches):
        number = shared.value
        for part in slices(batches):
            n, found = [], []
            for text in as_bytes(part.column("text")):
                words = terms_of(text)
                n.append(len(words))
                c = Counter(map(number.get, words))
                c.pop(None, None)
                found.append(c)
            if n:
                yield batch(schema, part.column("id"), n, *lists(found))

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(
        run, "id long, n long, terms array<int>, tfs array<int>")


def _best(scored: np.ndarray, top: int) -> np.ndarray:
    """Of rows (item, has id, id, score) each item's ``top``: highest score, then null ids, then smallest ids."""
    order = np.lexsort((scored[:, 2], scored[:, 1], -scored[:, 3], scored[:, 0]))
    scored = scored[order]
    first = np.searchsorted(scored[:, 0], scored[:, 0])
    return scored[np.arange(len(scored)) - first < top]


def best_of_parts(found: DataFrame, sharing: Sharing, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item int, id, score): each partition's ``top`` documents of each item, score above 0."""
    schema = pa.schema([("item", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
    shared = found.sparkSession.sparkContext.broadcast((sharing, weights))
    n_items = len(sharing.item_nodes)
    rows_at_once = max(1, min(4096, CELLS // max(1, sharing.n_nodes + n_items)))

    def run(batches):
        s, w = shared.value
        least = np.ones(n_items, np.int64)  # a score below can't be among the best
        kept, size = [np.empty((0, 4), np.int64)], 0

        def settle():
            nonlocal kept, size
            rows = _best(np.concatenate(kept), top)
            full = np.bincount(rows[:, 0], minlength=n_items) >= top
            last = np.full(n_items, np.iinfo(np.int64).max)
            np.minimum.at(last, rows[:, 0], rows[:, 3])
            least[full] = last[full]
            kept, size = [rows], 0

        for part in slices(batches, rows_at_once):
            if not part.num_rows:
                continue
            n = part.column("n").to_numpy()
            lists = part.column("terms")
            lengths = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(part.num_rows), lengths)
            term = lists.flatten().to_numpy().astype(np.int64)
            tf = part.column("tfs").flatten().to_numpy().astype(np.int64)
            m = 50 + (50 * n * n_docs) // max(1, n_terms)
            values = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            scores = accumulate(s, values, term, doc, part.num_rows)
            item, at = np.nonzero(scores >= least[:, None])
            if not item.size:
                continue
            ids = part.column("id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            kept.append(np.column_stack([item, known[at], number[at], scores[item, at]]))
            size += len(item)
            if size > 4 * top * n_items + 10_000:
                settle()
        settle()
        rows = kept[0]
        yield batch(schema, rows[:, 0].astype(np.int32), pa.array(rows[:, 2], pa.int64(), mask=rows[:, 1] == 0), rows[:, 3])

    return found.mapInArrow(run, "item int, id long, score long")


def _blocks(items: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """Parts of the item table that one pass serves: all rows of an id are in one part."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text_of(text_col))).alias("c")).first()
    parts = max(-(-size["n"] // BLOCK_ITEMS), -(-(size["c"] or 0) // BLOCK_CHARS))
    if parts <= 1:
        return [items] * min(1, parts)
    return [items.where(F.pmod(F.xxhash64(item_col), F.lit(parts)) == k) for k in range(parts)]


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = 50, item_col: str = "item_id",
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item id, rank, document id, score): each item's ``top`` documents, all rows of ``docs`` searched.

    Terms, weights and scores are integers as the query's contract sets them.
    Every row of ``docs`` is a document, repeated rows and rows of null id too
    (among equal scores a null id comes first, then ascending ids); null and empty
    texts have no terms.  Rows of ``items`` with equal ids are one item with the
    terms of all; an item without terms, or whose terms no document has, gives no
    row, as do empty tables.  Other columns are not read.

    A block of items takes two passes: over the texts, for its terms' counts
    (written, so nothing is tokenised twice), and over those counts.  The driver
    holds one block of items, its terms' document frequencies and the graph.
    """
    out = None
    for block in _blocks(items, item_col, text_col):
        texts: dict = defaultdict(set)
        for r in block.select(item_col, text_of(text_col)).toLocalIterator():
            texts[r[0]].update(terms_of(r[1].encode()))
        keys = sorted(texts, key=lambda x: (x is not None, x))
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*texts.values())))}
        if not vocabulary:
            continue
        found = materialise(postings(docs, vocabulary, id_col, text_col), "postings")
        sizes = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # at most one row per term of the block
            df[r[0]] = r[1]
        weights = np.array([math.floor(1000 * math.log((2 * sizes["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        sharing = mine([sorted(vocabulary[t] for t in texts[k]) for k in keys], len(vocabulary))
        best = best_of_parts(found, sharing, weights, sizes["docs"], sizes["terms"], top)
        # two steps: no task ranks more than a part of what all tasks found for an item
        order = [F.desc("score"), F.asc_nulls_first("id")]
        best = best.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
        best = best.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("r") <= top)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(keys)), f"item int, item_key {items.schema[item_col].dataType.simpleString()}")
        rows = best.join(F.broadcast(names), "item").select(F.col("item_key").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        kind = items.schema[item_col].dataType.simpleString()
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
    return out
