"""Byte-level BPE, encoding and decoding, by an index of pair occurrences.

The pieces that a partition's texts bring are laid out as one chain of symbols.
An index maps each pair that has a rank to all positions where it stands; the
active ranks are applied in ascending order, each to all its positions at once,
and every merge updates the lists of the pairs it makes.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import as_bytes, batch, slices, text_of
from churnkit.llm.tokens import _byte_letters, tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
#: fixed value: how byte-level tokenizers of this kind cut a text into pieces before they merge
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_PIECE = -2
GONE = -1


class PairIndexBpe:
    """Ids of whole texts as the tokenizer's library gives them, packed as little-endian uint32, and texts of ids."""

    CACHE = 1 << 19    # pieces whose ids are kept
    KEPT = 64          # longer pieces aren't
    TEXTS = 1 << 20    # characters of text that are cut into pieces at a time
    INDEXED = 1 << 19  # bytes of new pieces that one index holds (a longer piece alone)

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") \
                or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take more than their own characters")
        vocab, letters = model["vocab"], _byte_letters()
        self.byte_id = np.array([vocab[x] for x in letters], np.int32)
        self.width = max(vocab.values()) + 1
        self.ranks: dict[int, int] = {}
        self.made: list[tuple[int, int, int]] = []
        made_at: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, out = vocab[a], vocab[b], vocab[a + b]
            if (len(a) > 1 and left not in made_at) or (len(b) > 1 and right not in made_at) or out in made_at:
                raise ValueError(f"merge {rank} of {path} does not follow the merges of its parts, so ranks can't be applied in ascending order")
            made_at[out] = rank
            self.ranks[left * self.width + right] = rank
            self.made.append((left, right, out))
        self.first = np.full((256, 256), -1, np.int32)  # ranks of pairs of bytes
        byte_of = {int(x): k for k, x in enumerate(self.byte_id)}
        for rank, (left, right, _) in enumerate(self.made):
            if left in byte_of and right in byte_of:
                self.first[byte_of[left], byte_of[right]] = rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECE).findall
        self.cache: dict[str, bytes] = {}
        byte_at = {x: k for k, x in enumerate(letters)}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, k in [*vocab.items(), *self.special.items()]:
            known = all(c in byte_at for c in token)
            self.bytes_of[k] = bytes(byte_at[c] for c in token) if known else token.encode()

    # ------------------------------------------------------------------ encoding
    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces, all merged together through one pair index."""
        if not pieces:
            return []
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        start = self.byte_id[raw]
        start[ends] = END_OF_PIECE
        rank = self.first[raw[:-1], raw[1:]]
        rank[ends[:-1]] = -1
        rank[ends - 1] = -1
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        kinds, begin = np.unique(rank[at], return_index=True)
        index: dict[int, list[int] | np.ndarray] = dict(zip(kinds.tolist(), np.split(at, begin[1:])))
        active = kinds.tolist()  # ascending, so a heap
        sym = array("i", start.tobytes())
        after = array("i", np.arange(1, len(sym) + 1, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, len(sym) - 1, dtype=np.int32).tobytes())
        ranks, width, made = self.ranks, self.width, self.made
        while active:
            now = heapq.heappop(active)
            places = index.pop(now)
            if isinstance(places, np.ndarray):
                places = places.tolist()
            left, right, out = made[now]
            if left == right:
                places.sort()  # of overlapping pairs the first merges
            for p in places:
                q = after[p]
                if sym[p] != left or sym[q] != right:
                    continue
                sym[p], sym[q] = out, GONE
                n = after[p] = after[q]
                before[n] = p
                r = ranks.get(out * width + sym[n])
                if r is not None:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(active, r)
                b = before[p]
                if b >= 0:
                    r = ranks.get(sym[b] * width + out)
                    if r is not None:
                        if r in index:
                            index[r].append(b)
                        else:
                            index[r] = [b]
                            heapq.heappush(active, r)
        ids = np.frombuffer(sym, np.int32)
        ids = ids[ids != GONE]
        stops = np.flatnonzero(ids == END_OF_PIECE)
        packed, out, at = ids.astype("<u4").tobytes(), [], 0
        for s in stops.tolist():
            out.append(packed[4 * at:4 * s])
            at = s + 1
        return out

    def _learn(self, new: Iterable[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        part: list[str] = []
        raw: list[bytes] = []
        size = 0
        for p in new:
            b = p.encode()
            if size and size + len(b) > self.INDEXED:
                out.update(zip(part, self.merge(raw)))
                part, raw, size = [], [], 0
            part.append(p)
            raw.append(b)
            size += len(b) + 1
        out.update(zip(part, self.merge(raw)))
        return out

    def _cut(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text, each with the special id that follows it."""
        at = 0
        if self.cut is not None:
            for m in self.cut.finditer(text):
                yield text[at:m.start()], self.special[m.group()]
                at = m.end()
        yield text[at:], None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; special tokens' strings in a text become their ids, as is the library's default."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            todo, size = [], 0
            while at < len(texts) and (not size or size + len(texts[at]) <= self.TEXTS):
                todo.append([(self.pieces(t), k) for t, k in self._cut(texts[at])])
                size += len(texts[at]) + 1
                at += 1
            cache = self.cache
            new = {p for text in todo for part, _ in text for p in part if p not in cache}
            if len(cache) + len(new) > self.CACHE:
                cache.clear()
                new = {p for text in todo for part, _ in text for p in part}
            got = self._learn(new)
            cache.update(got)
            out += [b"".join([b"".join([cache[p] for p in part]) + (b"" if k is None else k.to_bytes(4, "little")) for part, k in text]) for text in todo]
            for p in got:
                if len(p) > self.KEPT:
                    del cache[p]
            if len(cache) > self.CACHE:
                cache.clear()
        return out

    # ------------------------------------------------------------------ decoding
    def decode(self, packed: bytes) -> str:
        """Text of packed ids, special tokens included; ids that the vocabulary lacks give nothing, broken UTF-8 its replacement character."""
        known = self.bytes_of
        ids = np.frombuffer(packed, "<u4").tolist()
        try:
            raw = b"".join([known[k] for k in ids])
        except IndexError:
            raw = b"".join([known[k] for k in ids if k < len(known)])
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> PairIndexBpe:
    """One per worker process, kept between tasks."""
    return PairIndexBpe(path)


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary): the ids of every whole text, little-endian uint32; one row per input row.

    Null text is empty and has no ids; a null or repeated id is passed on; an
    empty table gives an empty result; other columns are not read.  A narrow
    pass: no shuffle, and a lost task encodes its rows again to the same ids.
    """
    path = tokenizer or tokenizer_path(BYTE_BPE)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def run(batches):
        bpe = byte_bpe(path)
        for part in slices(batches):
            ids = bpe.encode([x or "" for x in part.column("text").to_pylist()])
            schema = pa.schema([part.schema.field("id"), ("n_tokens", pa.int64()), ("ids", pa.large_binary())])
            yield batch(schema, part.column("id"), [len(x) // 4 for x in ids], ids)

    return rows.mapInArrow(run, f"id {kind.simpleString()}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` and ``out_col``, the text of its packed ids (null ids: empty); a column of that name is replaced."""
    path = tokenizer or tokenizer_path(BYTE_BPE)
    rows = encoded.drop(out_col).withColumn(out_col, F.lit(""))

    def run(batches):
        bpe = byte_bpe(path)
        for part in slices(batches):
            if part.num_rows:
                k = part.schema.get_field_index(out_col)
                texts = pa.array([bpe.decode(x) for x in as_bytes(part.column(ids_col))], part.schema.field(k).type)
                yield part.set_column(k, part.schema.field(k), texts)

    return rows.mapInArrow(run, rows.schema)
