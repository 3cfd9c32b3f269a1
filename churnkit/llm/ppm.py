"""Language-model scores by prediction by partial matching, and a unigram base.

The model is a byte-context trie of up to ``ORDER`` symbols, trained on the
corpus: counts n(context, symbol) of every order.  A symbol is coded in the
longest context that training has seen; where that context has not seen the
symbol, an escape (method D: of a context seen t times with d distinct symbols,
d / 2t, and a symbol seen n times has (2n - 1) / 2t) goes to the next shorter one, in which the symbols of the longer one
are excluded, and at last to a uniform choice among the symbols left.  A text
is coded with an end symbol, after a fixed begin mark.

Counting is a map-side combine per task and one shuffle by (context, symbol);
shorter contexts are sums over longer ones.  For scoring, each task needs the
trie: it is cut by its contexts' last two symbols into shards of at most
``SHARD_BYTES`` each, which are broadcast one after another (one shard in all
but very large models).
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from churnkit.llm.common import as_bytes, batch, materialise, partitions, slices, text_of

ORDER = 5
BITS = 9
END, BEGIN = 256, 257  # symbols beside the 256 bytes; BEGIN occurs in contexts only
SYMBOLS = 257  # that can be coded: bytes and END
CHUNK = 1 << 20  # bytes of text whose positions are handled at once in a task
KEEP = 1 << 20  # distinct (context, symbol) pairs a task holds before it passes them on
SHARD_BYTES = 64 << 20
WORD_CHUNK = 1 << 23  # bytes of text that share a list of words
ENTRY_BYTES, CONTEXT_BYTES = 12, 24
MIX, PAIR_MIX = 0x9E3779B97F4A7C15, 0x9E3779B1


def chunks(texts: list[bytes], size: int = CHUNK):
    """Ranges of a list of texts of about ``size`` bytes, one text at least."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol of every coded position packed in 9-bit fields, first position of each text)."""
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    padded = np.full(total + order * len(texts), BEGIN, dtype=np.uint64)
    real = np.ones(len(padded), dtype=bool)
    begin = starts + order * np.arange(len(texts))
    for k in range(order):
        real[begin + k] = False
    flat = np.full(total, END, dtype=np.uint64)
    body = np.ones(total, dtype=bool)
    body[starts + lengths - 1] = False
    flat[body] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    padded[real] = flat
    key = padded.copy()
    for k in range(1, order + 1):
        key[k:] |= padded[:-k] << np.uint64(BITS * k)
    return key[real], starts


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n) of the highest order over a table of texts (column ``text``)."""
    out = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def merged(parts: list[pd.Series]) -> pd.Series:
        return pd.concat(parts).groupby(level=0, sort=False).sum()

    def emit(s: pd.Series):
        keys, n = s.index.to_numpy().astype(np.int64), s.to_numpy()
        for at in range(0, len(keys), 1 << 16):
            yield batch(out, keys[at:at + (1 << 16)], n[at:at + (1 << 16)])

    def run(batches):
        held, size = [], 0
        for b in slices(batches):
            own = as_bytes(b.column("text"))
            for i, j in chunks(own):
                s = pd.Series(grams([t.translate(LOWER) for t in own[i:j]], order)[0].view(np.int64)).value_counts(sort=False)
                held.append(s)
                size += len(s)
                if size > KEEP:
                    one = merged(held)
                    held, size = [one], len(one)
                    if size > KEEP // 2:
                        yield from emit(one)
                        held, size = [], 0
        if held:
            yield from emit(merged(held))

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def train(texts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of every order 0..order: entries (key, n) and contexts (ctx, t, d, next_t, left).

    t and d are a context's symbols and distinct symbols; next_t and left are those
    of the context one shorter without the symbols that this one has seen.
    """
    entries: list[DataFrame] = [None] * (order + 1)
    entries[order] = materialise(count_grams(texts, order), "grams")
    for o in range(order - 1, -1, -1):
        low = F.col("key").bitwiseAND(F.lit((1 << BITS * (o + 1)) - 1)).alias("key")
        entries[o] = materialise(entries[o + 1].groupBy(low).agg(F.sum("n").alias("n")), "grams")
    contexts: list[DataFrame] = []
    for o in range(order + 1):
        ctx = F.shiftright("key", BITS)
        own = entries[o].groupBy(ctx.alias("ctx")).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d"))
        if o:
            shorter = entries[o - 1].select(F.col("key").alias("low"), F.col("n").alias("low_n"))
            shared = (entries[o].withColumn("low", F.col("key").bitwiseAND(F.lit((1 << BITS * o) - 1))).join(shorter, "low")
                      .groupBy(F.shiftright("key", BITS).alias("ctx")).agg(F.sum("low_n").alias("e")))
            cs = contexts[o - 1].select(F.col("ctx").alias("low_ctx"), F.col("t").alias("lt"), F.col("d").alias("ld"))
            own = (own.join(shared, "ctx").withColumn("low_ctx", F.col("ctx").bitwiseAND(F.lit((1 << BITS * (o - 1)) - 1)))
                   .join(cs, "low_ctx").select("ctx", "t", "d", (F.col("lt") - F.col("e")).alias("next_t"), (F.col("ld") - F.col("d")).alias("left")))
        else:
            own = own.select("ctx", "t", "d", F.lit(0).cast("long").alias("next_t"), F.lit(0).cast("long").alias("left"))
        contexts.append(materialise(own, "contexts"))
    return entries, contexts


class Trie:
    """One shard of the model in sorted arrays, with a hash table for the longest contexts."""

    def __init__(self, arrays: dict, order: int, shard: int, shards: int):
        self.order, self.shard, self.shards = order, shard, shards
        self.entries = [(k.view(np.uint64), v) for k, v in arrays["entries"]]
        self.contexts = [(c.view(np.uint64), *v) for c, *v in arrays["contexts"]]
        self.distinct0 = arrays["distinct0"]
        keys, n = self.entries[order]
        t = self._context(order, keys >> np.uint64(BITS))[1][0]
        self._table(keys, np.log10((2 * n.astype(np.float64) - 1) / (2 * np.maximum(t, 1))).astype(np.float32))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.slot_key, self.slot_value = np.full(size, np.uint64(2**64 - 1)), np.zeros(size, dtype=np.float32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slot_key[at] == np.uint64(2**64 - 1)
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = np.zeros(len(todo), dtype=bool)
            won[one] = free[one]
            self.slot_key[at[won]], self.slot_value[at[won]] = keys[todo[won]], values[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(MIX)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def direct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, found) in the longest context."""
        at = self._slot(keys)
        got, value = self.slot_key[at], self.slot_value[at].astype(np.float64)
        hit = got == keys
        rest = np.flatnonzero(~hit & (got != np.uint64(2**64 - 1)))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self.slot_key) - 1)
            got = self.slot_key[at]
            same = got == keys[rest]
            hit[rest[same]] = True
            value[rest[same]] = self.slot_value[at[same]]
            more = ~same & (got != np.uint64(2**64 - 1))
            rest, at = rest[more], at[more]
        return value, hit

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def _context(self, o: int, ctx: np.ndarray):
        table, *values = self.contexts[o]
        at, hit = self._find(table, ctx)
        return hit, [v[at].astype(np.float64) if len(table) else np.zeros(len(ctx)) for v in values]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each coded position; 0 for positions of other shards."""
        out = np.zeros(len(keys))
        mine = np.arange(len(keys))
        if self.shards > 1:
            mine = np.flatnonzero(shard_of((keys >> np.uint64(BITS)) & np.uint64((1 << 2 * BITS) - 1), self.shards) == self.shard)
        value, hit = self.direct(keys[mine])
        out[mine[hit]] = value[hit]
        at = mine[~hit]
        key, logp = keys[at], np.zeros(len(at))
        after = np.zeros(len(at), dtype=bool)  # whether a longer context was tried
        rest_t, rest_d = np.zeros(len(at)), np.zeros(len(at))  # of the context at hand without what longer ones have seen
        done = np.zeros(len(at), dtype=bool)
        for o in range(self.order, -1, -1):
            k = key & np.uint64((1 << BITS * (o + 1)) - 1)
            known, (t, d, next_t, left) = self._context(o, k >> np.uint64(BITS))
            known &= ~done
            total, new = np.where(after, rest_t, t), np.where(after, rest_d, d)
            use = known & (new > 0)  # a context with no symbol left is passed without cost
            where, found = self._find(self.entries[o][0], k)
            found &= use
            if found.any():
                n = self.entries[o][1][where[found]].astype(np.float64)
                logp[found] += np.log10((2 * n - 1) / (2 * total[found]))
            miss = use & ~found
            logp[miss] += np.log10(new[miss] / (2 * total[miss]))
            done |= found
            rest_t, rest_d = np.where(known, next_t, rest_t), np.where(known, left, rest_d)
            after |= known
        rest = ~done
        logp[rest] -= np.where(after[rest], math.log10(max(1, SYMBOLS - self.distinct0)), math.log10(SYMBOLS))
        out[at] = logp
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j in chunks(texts):
            keys, starts = grams(texts[i:j], self.order)
            out[i:j] = np.add.reduceat(self.log10(keys), starts)
        return out


def shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a context by its last two symbols (18 bits; the product stays below 2 ** 50)."""
    return ((pair * np.uint64(PAIR_MIX)) >> np.uint64(12)) % np.uint64(shards)


def collect_shard(entries: list[DataFrame], contexts: list[DataFrame], order: int, shard: int, shards: int) -> dict:
    """One shard's arrays, sorted: at most about ``SHARD_BYTES``."""
    def part(df: DataFrame, o: int, last: F.Column) -> DataFrame:
        if shards == 1 or o < 2:
            return df
        mixed = F.shiftright(last.bitwiseAND(F.lit((1 << 2 * BITS) - 1)) * F.lit(PAIR_MIX), 12)
        return df.where(mixed % F.lit(shards) == shard)

    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy()

    def narrow(x: np.ndarray) -> np.ndarray:
        return x.astype(np.int32) if not len(x) or x.max() < 1 << 31 else x

    arrays: dict = {"entries": [], "contexts": []}
    for o in range(order + 1):
        t = part(entries[o], o, F.shiftright("key", BITS)).select("key", "n").toArrow()
        by = np.argsort(column(t, "key"))
        arrays["entries"].append((column(t, "key")[by], narrow(column(t, "n")[by])))
        t = part(contexts[o], o, F.col("ctx")).select("ctx", "t", "d", "next_t", "left").toArrow()
        by = np.argsort(column(t, "ctx"))
        arrays["contexts"].append((column(t, "ctx")[by], *[narrow(column(t, n)[by]) for n in ("t", "d", "next_t", "left")]))
    arrays["distinct0"] = len(arrays["entries"][0][0])
    return arrays


_TRIES: dict[str, Trie] = {}


def share(spark: SparkSession, entries: list[DataFrame], contexts: list[DataFrame], order: int, shard: int, shards: int):
    """(function for tasks that gives the shard's trie, built once per worker process; the broadcast behind it)."""
    name = uuid.uuid4().hex
    model = spark.sparkContext.broadcast((collect_shard(entries, contexts, order, shard, shards), order, shard, shards))

    def trie() -> Trie:
        if name not in _TRIES:
            _TRIES.clear()
            _TRIES[name] = Trie(*model.value)
        return _TRIES[name]

    return trie, model


def plan_shards(entries: list[DataFrame], contexts: list[DataFrame]) -> int:
    size = sum(e.count() for e in entries) * ENTRY_BYTES + sum(c.count() for c in contexts) * CONTEXT_BYTES
    return max(1, -(-size // SHARD_BYTES))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on documents whose crc32(id as text) mod 5 is not 1 (a null id counts
    as the empty text) and scores all, A-Z lower-cased.  Tokens are the words and
    one end; base_score is their add-half unigram log10 probability over training
    tokens, score the trie's log10 probability of the text.  Null text counts as
    empty; repeated rows come out repeatedly; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 1
    src = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.xxhash64(text_of(text_col)).alias("text_hash"),
                      text_of(text_col).alias("text"))
    entries, contexts = train(src.where("not held_out"), order)
    shards = plan_shards(entries, contexts)
    trie, _ = share(spark, entries, contexts, order, 0, shards)
    buckets = partitions(spark)
    table = materialise(_tokenised(src, trie, buckets), "token-chunks")
    totals = materialise(_word_totals(table, buckets), "word-counts")
    n, v = totals.where("bucket < 0").agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    counts = totals.where("bucket >= 0").select(F.col("chunk").alias("of"), "bucket", "counts")
    base = table.drop("hashes", "trained").groupBy("chunk").cogroup(counts.groupBy("of")).applyInArrow(
        _base_scores, "id string, held_out boolean, text_hash long, n_tokens long, n_known long, log_sum double, score double")
    out = base.select(F.col("id").cast(dict(src.dtypes)["id"]).alias("id"), "held_out", "text_hash", "n_tokens", "n_known",
                      F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("log_sum") - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"), "score")
    for shard in range(1, shards):  # a model beyond one shard: the other shards' share of each text, one pass each
        out = _add_shard(spark, src, out, entries, contexts, order, shard, shards)
    return out.drop("text_hash").withColumnRenamed("id", id_col)


def _tokenised(src: DataFrame, trie, buckets: int) -> DataFrame:
    """Rows of about ``WORD_CHUNK`` bytes of text.

    A row has its documents, their scores, and each document's words as sorted
    numbers into the row's list of distinct words (uint16 steps, uint8 times).
    The list itself, hashes in order and training counts, is cut by the hash in
    ``buckets`` parts.  Words are told apart by 64-bit hashes.
    """
    schema = ("chunk long, id array<string>, held_out array<boolean>, text_hash array<long>, score array<double>, first array<long>, "
              "steps binary, times binary, hashes array<binary>, trained array<binary>")
    out = pa.schema([("chunk", pa.int64()), ("id", pa.list_(pa.string())), ("held_out", pa.list_(pa.bool_())), ("text_hash", pa.list_(pa.int64())),
                     ("score", pa.list_(pa.float64())), ("first", pa.list_(pa.int64())), ("steps", pa.binary()), ("times", pa.binary()),
                     ("hashes", pa.list_(pa.binary())), ("trained", pa.list_(pa.binary()))])

    def run(batches):
        serial, task = 0, TaskContext.get().partitionId() << 32
        number: dict[bytes, int] = {b" ": 0}  # the end token: no word holds a space
        docs: list[tuple] = []
        tokens: list[np.ndarray] = []
        size = 0

        def flush():
            known, inverse = np.unique(np.fromiter(map(xxh3_64_intdigest, number), dtype=np.uint64, count=len(number)), return_inverse=True)
            lengths = np.array([len(t) for t in tokens])
            held = np.array([d[1] for d in docs], dtype=bool)
            word = inverse[np.concatenate(tokens)]
            own = np.repeat(np.arange(len(docs), dtype=np.int64), lengths)
            trained = np.bincount(word[~held[own]], minlength=len(known)).astype("<u4")
            cell, times = np.unique(own << 32 | word, return_counts=True)
            own, word = cell >> 32, cell & 0xFFFFFFFF
            steps, times, first = _packed(own, word, times, len(docs))
            edge = np.searchsorted(known, (np.arange(1, buckets, dtype=object) * 2**64 // buckets).astype(np.uint64))
            ids, held, hashes, scores = map(list, zip(*docs))
            return batch(out, [task + serial], [ids], [held], [hashes], [scores], [first.tolist()], [steps.tobytes()], [times.tobytes()],
                         [[x.astype("<u8").tobytes() for x in np.split(known, edge)]], [[x.tobytes() for x in np.split(trained, edge)]])

        for b in slices(batches):
            texts = [t.translate(LOWER) for t in as_bytes(b.column("text"))]
            docs += zip(*(b.column(c).to_pylist() for c in ("id", "held_out", "text_hash")), trie().scores(texts).tolist())
            for t in texts:
                own = np.fromiter((number.setdefault(w, len(number)) for w in t.split()), dtype=np.int32)
                tokens.append(np.r_[own, np.int32(0)])
                size += len(t)
            if size > WORD_CHUNK:
                yield flush()
                serial, number, docs, tokens, size = serial + 1, {b" ": 0}, [], [], 0
        if docs:
            yield flush()

    return src.withColumn("id", F.col("id").cast("string")).select("id", "held_out", "text_hash", "text").mapInArrow(run, schema)


def _packed(own: np.ndarray, word: np.ndarray, times: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uint16 steps from word to word of a document, uint8 times, first cell of each document and the end).

    A step or number of times beyond its type is spread over several cells; cells of no times only step.
    """
    step = np.where(np.r_[True, own[1:] != own[:-1]], word, np.diff(word, prepend=0))
    far, many = step // 0xFFFF, (np.maximum(times, 1) - 1) // 0xFF
    cells = 1 + far + many
    at = np.cumsum(cells) - cells
    steps, out = np.zeros(int(cells.sum()), dtype="<u2"), np.zeros(int(cells.sum()), dtype=np.uint8)
    for k in np.flatnonzero(far):
        steps[at[k]:at[k] + far[k]] = 0xFFFF
    steps[at + far] = step % 0xFFFF
    out[at + far] = times - 255 * many
    for k in np.flatnonzero(many):
        out[at[k] + far[k] + 1:at[k] + cells[k]] = 255
    first = np.r_[np.searchsorted(own, np.arange(n_docs)), len(own)]
    return steps, out, np.r_[at, len(steps)][first]


def _word_totals(table: DataFrame, buckets: int) -> DataFrame:
    """Rows (chunk, bucket, counts): training counts over the corpus of the words of a part of a list, in its order;
    and one row of each bucket with bucket -1: n training tokens, v distinct words of them."""
    parts = table.select("chunk", F.posexplode(F.arrays_zip("hashes", "trained")).alias("bucket", "w")).select("chunk", "bucket", "w.hashes", "w.trained")
    out = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])

    def run(batches):
        rows = [(c, k, np.frombuffer(h, "<u8"), np.frombuffer(t, "<u4")) for b in batches
                for c, k, h, t in zip(*(b.column(x).to_pylist() for x in ("chunk", "bucket", "hashes", "trained")))]
        if not rows:
            return
        known, inverse = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([r[3] for r in rows]), minlength=len(known)).astype(np.int64)
        yield batch(out, [-1], [-1], [b""], [int(total.sum())], [int((total > 0).sum())])
        at = 0
        for c, k, h, _ in rows:
            yield batch(out, [c], [k], [total[inverse[at:at + len(h)]].astype("<i8").tobytes()], [0], [0])
            at += len(h)

    return parts.repartition(buckets, "bucket").mapInArrow(run, "chunk long, bucket int, counts binary, n long, v long")


def _base_scores(chunk: pa.Table, counts: pa.Table) -> pa.Table:
    names = ["id", "held_out", "text_hash", "n_tokens", "n_known", "log_sum", "score"]
    types = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    columns: list = [[] for _ in names]
    if chunk.num_rows:
        r = chunk.to_pylist()[0]
        by = sorted(zip(counts.column("bucket").to_pylist(), counts.column("counts").to_pylist()))
        c = np.frombuffer(b"".join(x for _, x in by), "<i8")
        first, times = np.array(r["first"]), np.frombuffer(r["times"], np.uint8).astype(np.int64)
        walk = np.cumsum(np.frombuffer(r["steps"], "<u2").astype(np.int64))
        begin = np.r_[0, walk][first[:-1]]
        word = walk - np.repeat(begin, np.diff(first))
        seen = c[np.minimum(word, len(c) - 1)]
        cells = np.stack([times, times * (seen > 0), times * np.log10(seen + 0.5)])
        sums = np.add.reduceat(cells, first[:-1], axis=1)  # every document has its end token
        columns = [r["id"], r["held_out"], r["text_hash"], sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2], r["score"]]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=names)


def _add_shard(spark: SparkSession, src: DataFrame, out: DataFrame, entries, contexts, order: int, shard: int, shards: int) -> DataFrame:
    trie, model = share(spark, entries, contexts, order, shard, shards)
    schema = pa.schema([("text_hash", pa.int64()), ("more", pa.float64())])

    def run(batches):
        for b in slices(batches):
            texts = [t.translate(LOWER) for t in as_bytes(b.column("text"))]
            yield batch(schema, b.column("text_hash"), trie().scores(texts))

    part = src.select("text_hash", "text").mapInArrow(run, "text_hash long, more double")
    part = materialise(part.groupBy("text_hash").agg(F.max("more").alias("more")), "shard-scores")
    model.unpersist()
    return materialise(out.join(part, "text_hash").withColumn("score", F.col("score") + F.col("more")).drop("more"), "scores")
