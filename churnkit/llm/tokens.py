"""Encoding with a public tokenizer inside tasks, with a bounded cache of words."""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np

WORD_BPE = "word_bpe_49k.json"
#: letters that normalisation maps one to one to lower case, then punctuation (no apostrophe: some are split off with letters)
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that runs it."""
    lib = __import__("sentencepiece" if path.endswith(".model") else "tokenizers")
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + lib.__version__.encode()).hexdigest()


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 stands for itself, the rest from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    """Token ids of whole texts, exactly as the library gives them, as packed little-endian uint32.

    The word tokenizer drops white space before it splits words, so it never merges
    over white space and a text's ids are those of its words in turn; ids of
    ``CACHE`` words are kept.  A word of plain letters and punctuation goes straight
    to the tokenizer's model, other words to the whole library.  Texts that may hold
    a special token, and all other tokenizers, take the library's own path.
    """

    CACHE = 1 << 20
    LONG = 64  # longer words aren't kept
    MARK = "<|"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.by_words = False
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.many = lambda texts: model.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        self.many = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        self.by_words = os.path.basename(path) == WORD_BPE
        self.model, self.letters = tok.model, _byte_letters()
        self.cache: dict[str, bytes] = {}
        self.marks: dict[str, list[int]] = {"": []}

    def _piece(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = "".join([self.letters[b] for b in piece.encode()])
        return [t.id for t in self.model.tokenize(piece)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words that the cache doesn't have."""
        out, hard = {}, []
        for w in new:
            m = SIMPLE.fullmatch(w)
            if m is None:
                hard.append(w)
                continue
            mark = m[2]
            if mark not in self.marks:
                if len(self.marks) > 4096:
                    self.marks = {"": []}
                self.marks[mark] = self._piece(mark)
            out[w] = _packed(self._piece(m[1].lower()) + self.marks[mark])
        for at in range(0, len(hard), 4096):
            part = hard[at:at + 4096]
            out.update(zip(part, map(_packed, self.many(part))))
        return out

    def _by_words(self, texts: list[list[str]]) -> list[bytes]:
        cache = self.cache
        new = {w for words in texts for w in words if w not in cache}
        got = self._learn(new)
        if len(cache) + len(got) > self.CACHE:
            cache.clear()
            got.update(self._learn({w for words in texts for w in words if w not in got}))
        both = cache
        cache.update((w, x) for w, x in got.items() if len(w) <= self.LONG)
        long = {w: x for w, x in got.items() if len(w) > self.LONG}
        if long:
            both = _Either(cache, long)
        return [b"".join([both[w] for w in words]) for words in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if not self.by_words:
            return [_packed(x) for x in self.many(texts)]
        out: list[bytes] = []
        at = 0
        while at < len(texts):  # a few texts at a time, so that what is new to the cache stays bounded
            part, size = [], 0
            while at < len(texts) and size < 1 << 20:
                part.append(texts[at])
                size += len(texts[at])
                at += 1
            got = iter(self._by_words([_split(t) for t in part if self.MARK not in t]))
            out += [next(got) if self.MARK not in t else _packed(self.many([t])[0]) for t in part]
        return out


class _Either(dict):
    def __init__(self, cache: dict, rest: dict):
        super().__init__(rest)
        self.cache = cache

    def __missing__(self, w: str) -> bytes:
        return self.cache[w]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _split(text: str) -> list[str]:
    """Words between ASCII white space (other white space stays inside a word, for the tokenizer to drop)."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w.decode() for w in text.encode().split()]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    return Encoder(path)
