"""Repeated passages by blockwise suffix sorting with a difference cover.

Every window of ``min_length`` bytes of the corpus is a suffix that has to be
sorted ``min_length`` deep.  To sort one bucket of suffixes at a time, windows
are dealt to buckets by content: the minimizer of a window is the smallest hash
among its ``k``-byte grams, so equal windows share it wherever they stand, and
consecutive windows with one minimizer travel together as one block (start,
number of windows, hash of the block's bytes).

1. Blocks that are equal byte for byte collapse to the earliest one, first
   within a task's batch and then within the bucket: all windows of a later copy
   occur earlier.  A bucket of which one distinct block is left is done.
2. Of the other buckets, the texts of the distinct blocks are fetched and their
   suffixes sorted bucket by bucket: by their first ``COVER`` bytes, and where
   these tie by the precomputed ranks of a sample of suffixes, the positions in a
   difference cover.  For any two suffixes there is a shift below ``COVER`` that
   takes both to sampled positions, so one look-up settles a tie of any length.
   In the sorted order equal windows stand side by side; all but the earliest are
   marked.
3. A document's marked windows are joined to its text; what they cover goes.

A bucket that a sample of documents shows to be very large is split by the
block's hash in step 1 and by the window's distance to the minimizer in step 2;
equal windows still meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.ordering import global_index
from churnkit.llm.common import batch, materialise, partitions, text_of, whole

PIECE = 1 << 18  # windows of a long text handled at once
GROUP = 1 << 19  # bytes of short texts handled at once; positions must fit LOW
LOW = np.uint64((1 << 20) - 1)
FIELD = 12  # bits of a block's number of windows and of its minimizer's distance
COVER = 31
#: a perfect difference set modulo 31: every shift is a difference of two members
COVER_SET = (1, 5, 11, 24, 25, 27)
HOT_SHARE, HOT_LEAST = 20_000, 32  # a bucket is large from 1/HOT_SHARE of the sampled blocks, HOT_LEAST at least
SAMPLE = 64  # one document in so many is sampled to find large buckets
SPREAD = 64

_RNG = np.random.default_rng(20240521)
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0xD1342543DE82EF95


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: int) -> np.ndarray:
    out = np.full((1 << 20) + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, base: int) -> np.ndarray:
    if name not in _TABLES:
        _TABLES[name] = _powers(base)
    return _TABLES[name]


def gram_hashes(c: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every run of k values, by doubling."""
    out, have, part, width = None, 0, c, 1
    while width <= k:
        if k & width:
            if out is None:
                out, have = part, width
            else:
                n = len(c) - have - width + 1
                out = out[:n] * np.uint64(pow(BASE, width, 2**64)) + part[have:have + n]
                have += width
        part = part[:-width] * np.uint64(pow(BASE, width, 2**64)) + part[width:] if len(part) > width else part[:0]
        width *= 2
    return out


def blocks(pieces: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """(piece, start, windows, minimizer's distance, minimizer, hash of the block) of each block of windows."""
    buf = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    none = np.empty(0, dtype=np.int64)
    if len(buf) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    ends = np.cumsum(sizes)
    c = BYTE[buf]
    h = mixed(gram_hashes(c, k))
    low = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    span, width = length - k + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    piece = np.repeat(np.arange(len(pieces)), sizes)[:len(low)]
    at = np.flatnonzero(np.arange(len(low)) + length <= ends[piece])
    if not len(at):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    best, own = (low[at] & LOW).astype(np.int64), piece[at]
    head = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (own[1:] != own[:-1])])
    start, windows = at[head], np.diff(np.r_[head, len(at)])
    stop = start + windows - 1 + length
    prefix = np.r_[np.uint64(0), np.cumsum(c * _table("power", BASE)[:len(c)])]
    content = (prefix[stop] - prefix[start]) * _table("inverse", pow(BASE, -1, 2**64))[start]
    content = mixed(content + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return own[head], start - (ends - sizes)[own[head]], windows, best[head] - start, h[best[head]], content


def words(buf: np.ndarray) -> np.ndarray:
    """Big-endian 64-bit word that begins at each byte (zeros after the end)."""
    padded = np.r_[buf, np.zeros(8, dtype=np.uint8)].astype(np.uint64)
    out = np.zeros(len(buf), dtype=np.uint64)
    for k in range(8):
        out |= padded[k:k + len(buf)] << np.uint64(56 - 8 * k)
    return out


def _refine(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Dense ranks of (group, key)."""
    order = np.lexsort((key, group))
    g, x = group[order], key[order]
    rank = np.empty(len(group), dtype=np.int64)
    rank[order] = np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
    return rank


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.bincount(rank, minlength=len(rank))[rank] > 1


def ranks(word: np.ndarray, end: np.ndarray, at: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Ranks (ties equal) of the suffixes at ``at`` up to their ``end``, or ``depth`` bytes, word by word."""
    rank = np.zeros(len(at), dtype=np.int64)
    live, shift = np.arange(len(at)), 0
    while len(live) and (depth is None or shift < depth):
        p = at[live] + shift
        inside = p < end[live]
        if not inside.any():
            break
        key = np.where(inside, word[np.minimum(p, len(word) - 1)], np.uint64(0))
        if depth is not None and depth - shift < 8:
            key &= ~np.uint64(0) << np.uint64(8 * (8 - (depth - shift)))
        # ranks of one tie group are spread over the places its members hold, so other groups keep theirs
        sub = _refine(rank[live], key)
        order = np.argsort(rank[live], kind="stable")
        group = rank[live][order]
        first = np.r_[True, group[1:] != group[:-1]]
        s = np.sort(sub)
        place = np.searchsorted(s, sub, side="left")
        begin = np.flatnonzero(first)
        start_of = np.repeat(begin, np.diff(np.r_[begin, len(group)]))
        base = np.empty(len(group), dtype=np.int64)
        base[order] = start_of
        rank[live] = rank[live] + place - base
        live = live[_tied(_refine(rank[live], np.zeros(len(live), dtype=np.uint64)))]
        shift += 8
    return rank


def cover_tables() -> tuple[np.ndarray, np.ndarray]:
    """(whether a residue is in the cover, [i, j] shift below COVER that takes both residues into it)."""
    member = np.isin(np.arange(COVER), COVER_SET)
    shift = np.full((COVER, COVER), -1, dtype=np.int64)
    for d in range(COVER):
        hit = member[(np.arange(COVER) + d) % COVER]
        both = hit[:, None] & hit[None, :] & (shift < 0)
        shift[both] = d
    return member, shift


def sort_suffixes(buf: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``at`` of ``buf``; ``end`` is the end of the text that each byte stands in."""
    word = words(buf)
    member, shift = cover_tables()
    sampled = np.flatnonzero(member[np.arange(len(buf)) % COVER] & (np.arange(len(buf)) < end))
    sample_rank = np.full(len(buf) + COVER, -1, dtype=np.int64)  # past a text's end: before all
    sample_rank[sampled] = ranks(word, end[sampled], sampled)
    rank = ranks(word, end[at], at, depth=COVER)
    live = np.flatnonzero(_tied(rank))
    while len(live):  # three-way partition of all tie groups at once, around one member each
        order = live[np.argsort(rank[live], kind="stable")]
        group = rank[order]
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[begin, len(group)])
        pivot = np.repeat(at[order[begin + size // 2]], size)
        mine = at[order]
        d = shift[mine % COVER, pivot % COVER]
        a, b = mine + d, pivot + d
        ra = np.where(a < end[mine], sample_rank[np.minimum(a, len(sample_rank) - 1)], -1)
        rb = np.where(b < end[pivot], sample_rank[np.minimum(b, len(sample_rank) - 1)], -1)
        side = np.sign(ra - rb) + 1  # 0 before the pivot, 1 equal to it, 2 after
        number = np.repeat(np.arange(len(begin)), size)
        count = np.zeros((len(begin), 3), dtype=np.int64)
        np.add.at(count, (number, side), 1)
        offset = np.cumsum(count, axis=1) - count
        rank[order] = group + offset[number, side]
        live = order[(side != 1) & (count[number, side] > 1)]
    return np.argsort(rank, kind="stable")


def repeated_windows(slices: list[bytes], place: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For each window of the slices (slice after slice) whether an equal one has a smaller ``place``.

    ``place`` orders the windows; it is an array over all windows.
    """
    sizes = np.array([len(s) + 8 for s in slices], dtype=np.int64)
    buf = np.frombuffer(b"".join(s + b"\0" * 8 for s in slices), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    end = np.repeat(begin + sizes - 8, sizes)
    at = np.repeat(begin, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    order = sort_suffixes(buf, end, at)
    s, word = at[order], words(buf)
    same = np.ones(max(0, len(s) - 1), dtype=bool)
    for k in range(0, length, 8):
        x = word[s + k]
        if length - k < 8:
            x &= ~np.uint64(0) << np.uint64(8 * (8 - (length - k)))
        same &= x[1:] == x[:-1]
    head = np.flatnonzero(np.r_[True, ~same])
    first = np.minimum.reduceat(place[order], head)
    out = np.zeros(len(at), dtype=bool)
    out[order] = place[order] > np.repeat(first, np.diff(np.r_[head, len(s)]))
    return out


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (ord, id, text), ord giving the documents' order (ids serve as they are where they are unique),
    and one row per ord of them: rows that repeat id and text are one document."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    ids = base.groupBy("id").count()
    if ids.where("id is null or count > 1").isEmpty():
        base = base.select(F.col("id").alias("ord"), "id", "text")
        return base, base
    keyed = base.withColumn("h", F.xxhash64("text"))
    number = global_index(keyed.select("id", "h").distinct(), [F.col("id").asc_nulls_last(), F.col("h").asc()], "ord")
    number = materialise(number.select(F.col("id").alias("i"), F.col("h").alias("hh"), "ord"), "document-order")
    rows = keyed.join(number, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh"))).select("ord", "id", "text")
    return rows, materialise(rows.dropDuplicates(["ord"]), "distinct-documents")


def _find_blocks(docs: DataFrame, length: int, k: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Rows (bucket, g, h, ord, block, done): done blocks repeat an earlier one of the same batch; nothing more
    needs to be known of them, so they are dealt out evenly."""
    out = pa.schema([("bucket", pa.int32()), ("g", pa.int64()), ("h", pa.int64()), ("ord", pa.int64()), ("block", pa.int64()), ("done", pa.bool_())])

    def groups(rows: list[tuple[int, bytes]]):
        held, size = [], 0
        for o, text in rows:
            if len(text) < length:
                continue
            for at in range(0, len(text) - length + 1, PIECE):
                part = text[at:at + PIECE + length - 1]
                if held and size + len(part) > GROUP:
                    yield held
                    held, size = [], 0
                held.append((o, at, part))
                size += len(part)
        if held:
            yield held

    def run(batches):
        for b in batches:
            rows = sorted(zip(b.column("ord").to_pylist(), (t.encode() for t in b.column("text").to_pylist())), key=lambda r: r[0])
            found = []
            for held in groups(rows):
                piece, start, windows, dist, g, h = blocks([p for _, _, p in held], length, k)
                o, base = np.array([x[0] for x in held], dtype=np.int64)[piece], np.array([x[1] for x in held], dtype=np.int64)[piece]
                found.append((g, h, o, ((start + base) << (2 * FIELD)) | (windows << FIELD) | dist))
            if not found:
                continue
            g, h, o, block = (np.concatenate(x) for x in zip(*found))
            both = mixed(g * np.uint64(0x9FB21C651E98DF25) + h)
            order = np.argsort(both, kind="stable")  # blocks came in order, so the first of equal ones is the earliest
            s = both[order]
            repeat = np.r_[False, s[1:] == s[:-1]] & np.r_[False, g[order][1:] == g[order][:-1]] & np.r_[False, h[order][1:] == h[order][:-1]]
            done = np.zeros(len(g), dtype=bool)
            done[order] = repeat
            salt = np.where(np.isin(g, hot), h % np.uint64(SPREAD), np.uint64(0)) if len(hot) else np.uint64(0)
            place = mixed(g + salt * np.uint64(0xA0761D6478BD642F))
            place[done] = mixed(o[done].view(np.uint64) ^ block[done].view(np.uint64) * np.uint64(0xA0761D6478BD642F))  # settled: anywhere
            bucket = (place % np.uint64(buckets)).astype(np.int32)
            for at in range(0, len(g), 1 << 16):
                z = slice(at, at + (1 << 16))
                yield batch(out, bucket[z], g[z].view(np.int64), h[z].view(np.int64), o[z], block[z], done[z])

    return docs.select("ord", "text").mapInArrow(run, "bucket int, g long, h long, ord long, block long, done boolean")


def _marks(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Rows (ord, start, windows): runs of windows that occur earlier."""
    spark = docs.sparkSession
    parts = partitions(spark)
    none = np.empty(0, dtype=np.uint64)
    sample = _find_blocks(docs.where(F.pmod(F.xxhash64("ord"), F.lit(SAMPLE)) == 0), length, k, 1, none).groupBy("g").count()
    sample = materialise(sample, "sampled-buckets")
    total = sample.agg(F.sum("count")).first()[0] or 0
    large = sample.where(F.col("count") >= max(HOT_LEAST, total // HOT_SHARE)).select("g").collect()  # HOT_SHARE rows at most
    hot = np.sort(np.array([r.g for r in large], dtype=np.int64).view(np.uint64))

    found = _find_blocks(docs, length, k, parts * 16, hot).repartition(parts, "bucket").select("g", "h", "ord", "block", "done")
    out = pa.schema([("g", pa.int64()), ("ord", pa.int64()), ("block", pa.int64()), ("done", pa.bool_())])

    def collapse(batches):
        rows = whole(batches, ["g", "h", "ord", "block", "done"])
        g, h, o, block, done = (rows[n] for n in ("g", "h", "ord", "block", "done"))
        if not len(g):
            return
        done = done.astype(bool)

        def rows_of(at: np.ndarray, flag: bool):
            for i in range(0, len(at), 1 << 16):
                z = at[i:i + (1 << 16)]
                yield batch(out, g[z], o[z], block[z], np.full(len(z), flag))

        yield from rows_of(np.flatnonzero(done), True)
        live = np.flatnonzero(~done)
        order = live[np.lexsort((block[live], o[live], h[live], g[live]))]
        if not len(order):
            return
        gs, hs = g[order], h[order]
        new_g = np.r_[True, gs[1:] != gs[:-1]]
        first = new_g | np.r_[True, hs[1:] != hs[:-1]]
        number = np.cumsum(new_g) - 1
        several = (np.bincount(number[first], minlength=number[-1] + 1) > 1)[number]
        if len(hot):
            several |= np.isin(gs.view(np.uint64), hot)
        yield from rows_of(order[~first], True)
        yield from rows_of(order[first & several], False)

    marked = materialise(found.mapInArrow(collapse, "g long, ord long, block long, done boolean"), "blocks")
    start = F.shiftright("block", 2 * FIELD).alias("start")
    windows = F.shiftright("block", FIELD).bitwiseAND(F.lit((1 << FIELD) - 1)).cast("int").alias("windows")
    copies = marked.where("done").select("ord", start, windows)

    # the texts of blocks whose bucket holds several, then the sort
    wanted = marked.where("not done").groupBy(F.col("ord").alias("o")).agg(F.collect_list(F.struct("g", "block")).alias("blocks"))
    texts = docs.select("ord", "text").join(wanted.hint("shuffle_hash"), F.col("ord") == F.col("o")).select("ord", "text", "blocks")
    cut = pa.schema([("bucket", pa.int64()), ("ord", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("slice", pa.binary())])

    def fetch(batches):
        for b in batches:
            rows = []
            for o, text, wanted in zip(*(b.column(c).to_pylist() for c in ("ord", "text", "blocks"))):
                raw = text.encode()
                for w in wanted:
                    g, block = w["g"], w["block"]
                    s, n, dist = block >> (2 * FIELD), (block >> FIELD) & ((1 << FIELD) - 1), block & ((1 << FIELD) - 1)
                    if not is_hot(g):
                        rows.append((g, o, s, n, raw[s:s + n - 1 + length]))
                        continue
                    for d in range((dist - n + 1) // STEP, dist // STEP + 1):  # windows dist, dist - 1, ... from the minimizer
                        far, near = min(dist, d * STEP + STEP - 1), max(dist - n + 1, d * STEP)
                        i, m = dist - far, far - near + 1
                        rows.append((_salted(g, d), o, s + i, m, raw[s + i:s + i + m - 1 + length]))
                if len(rows) > 1 << 15:
                    yield batch(cut, *zip(*rows))
                    rows = []
            if rows:
                yield batch(cut, *zip(*rows))

    hot_set = frozenset(hot.view(np.int64).tolist())
    is_hot = hot_set.__contains__
    slices = texts.mapInArrow(fetch, "bucket long, ord long, start long, windows int, slice binary").repartition(parts, "bucket")
    span = pa.schema([("ord", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())])

    def sort(batches):
        rows: dict[str, list] = {n: [] for n in ("bucket", "ord", "start", "windows", "slice")}
        for b in batches:
            for n in rows:
                rows[n].append(b.column(n))
        if not rows["bucket"]:
            return
        bucket, o, s, n = (np.concatenate([x.to_numpy(zero_copy_only=False) for x in rows[c]]) for c in ("bucket", "ord", "start", "windows"))
        texts = [t for x in rows["slice"] for t in x.to_pylist()]
        order = np.lexsort((s, o, bucket))
        edge = np.r_[0, np.flatnonzero(bucket[order][1:] != bucket[order][:-1]) + 1, len(order)]
        at = 0
        while at < len(edge) - 1:  # some whole buckets at a time
            end, size = at + 1, int(n[order[edge[at]:edge[at + 1]]].sum())
            while end < len(edge) - 1 and size < 1 << 17:
                size += int(n[order[edge[end]:edge[end + 1]]].sum())
                end += 1
            part = order[edge[at]:edge[end]]
            part = part[np.lexsort((s[part], o[part]))]  # so that the window's number gives its place
            many = n[part].astype(np.int64)
            got = repeated_windows([texts[i] for i in part], np.arange(int(many.sum())), many, length)
            oo, where = np.repeat(o[part], many), np.repeat(s[part], many) + np.arange(len(got)) - np.repeat(np.cumsum(many) - many, many)
            oo, where = oo[got], where[got]
            if len(oo):
                head = np.flatnonzero(np.r_[True, (oo[1:] != oo[:-1]) | (where[1:] != where[:-1] + 1)])
                yield batch(span, oo[head], where[head], np.diff(np.r_[head, len(oo)]).astype(np.int32))
            at = end

    return copies.unionByName(materialise(slices.mapInArrow(sort, "ord long, start long, windows int"), "repeats"))


STEP = 4


def _salted(g: int, d: int) -> int:
    """The part of a large bucket for windows at one distance (in steps) from the minimizer."""
    return int(mixed(np.array([(g + d * 0xE7037ED1A0B428DB) & (2**64 - 1)], dtype=np.uint64)).view(np.int64)[0])


def dedup_passages(docs: DataFrame, min_length: int = 100, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text with ``with_text``).

    A byte goes if a string of ``min_length`` bytes that covers it also starts
    earlier: in a smaller id (null ids last, ties by a hash of the text), or
    earlier in the same text; overlaps count, matches don't cross documents and
    are judged on the input.  Rows that repeat id and text are one document: each
    gives the same row, and neither is earlier than the other.  Null text counts
    as empty; an empty table gives an empty result; other columns are not read.
    ``kept_text`` is the remaining bytes (they may cut a character).
    """
    k = max(1, min(24, min_length // 4))
    if not 2 <= min_length < 1 << FIELD:
        raise ValueError(f"min_length must be from 2 to {(1 << FIELD) - 1}")
    base, single = _ordered(docs, id_col, text_col)
    marks = _marks(single, min_length, k)
    per_doc = marks.groupBy(F.col("ord").alias("o")).agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    joined = base.join(per_doc.hint("shuffle_hash"), F.col("ord") == F.col("o"), "left").select("id", "text", "marks")
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        fields, schema = [*fields, ("kept_text", pa.binary())], schema + ", kept_text binary"
    out = pa.schema(fields)

    def run(batches):
        for b in batches:
            marks = b.column("marks")
            offsets, valid = marks.offsets.to_numpy(), marks.is_valid().to_numpy(zero_copy_only=False)
            flat = marks.values
            starts, runs = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "windows"))
            rows = []
            for r, (i, text) in enumerate(zip(b.column("id").to_pylist(), b.column("text").to_pylist())):
                raw = text.encode()
                spans: list[tuple[int, int]] = []
                if valid[r] and offsets[r] < offsets[r + 1]:
                    z = slice(offsets[r], offsets[r + 1])
                    order = np.argsort(starts[z], kind="stable")
                    a = starts[z][order].astype(np.int64)
                    reach = np.maximum.accumulate(a + runs[z][order] - 1 + min_length)
                    head = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
                    spans = list(zip(a[head].tolist(), reach[np.r_[head[1:], len(a)] - 1].tolist()))
                kept, at = [], 0
                for x, y in spans:
                    kept.append(raw[at:x])
                    at = y
                left = b"".join([*kept, raw[at:]])
                row = (i, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest())
                rows.append((*row, left) if with_text else row)
            if rows:
                yield batch(out, *zip(*rows))

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
