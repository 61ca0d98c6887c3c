"""Encoding of texts with a public byte-level BPE tokenizer, in batched numpy merge rounds.

The words of a batch that the worker hasn't met yet lie in one flat array of symbols. A
round finds the rank of every adjacent pair by binary search over the sorted pair keys,
takes each word's lowest, and merges all its occurrences at once. A merge can only make
pairs of higher rank, so that this gives what one merge at a time gives.

Nulls and empty texts give the empty list; blank texts are encoded as they stand. Whole
texts are encoded, of any length. The operator is a map: no shuffle, and memory is bounded
by an Arrow batch and the word cache.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH = "/opt/tokenizers/byte_bpe_50k.json"
CACHED_WORDS, CACHED_CHARS = 200_000, 64
NONE = np.iinfo(np.int64).max
# Fixed value of the tokenizer: how a text falls into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: itself if it is visible
    in Latin-1, else the next free letter from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Merges:
    """The vocabulary as arrays: sorted pair keys with their rank and the merged id."""

    def __init__(self, path: str = PATH):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        back = {c: b for b, c in letters.items()}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[int(i)] for i in ids).decode("utf-8", errors="replace")

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; words are non-empty."""
        if not words:
            return []
        raw = [w.encode("utf-8", errors="replace") for w in words]
        sym = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(sym), NONE, dtype=np.int64)
            at = np.zeros(len(sym), dtype=np.int64)
            if len(sym) > 1:
                pair = sym[:-1] * self.size + sym[1:]
                found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
                hit = (self.keys[found] == pair) & (word[1:] == word[:-1])
                rank[:-1][hit] = self.rank[found[hit]]
                at[:-1] = found
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            over = least == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            go = ~over
            merge = (rank == least) & go
            p = np.flatnonzero(merge)
            if len(p):
                # of overlapping pairs (aaa) every second one, from the left
                starts = np.r_[True, np.diff(p) != 1]
                run = np.maximum.accumulate(np.where(starts, np.arange(len(p)), 0))
                p = p[(np.arange(len(p)) - run) % 2 == 0]
                sym[p] = self.made[at[p]]
                go[p + 1] = False
            sym, word = sym[go], word[go]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return [x.tolist() for x in np.split(sym[order], np.cumsum(np.bincount(word, minlength=len(raw)))[:-1])]


class Encoder:
    """Texts to ids with a bounded cache of words."""

    def __init__(self, merges: Merges):
        self.merges, self.split, self.cache = merges, regex.compile(WORDS), {}

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split.findall(t) if t else [] for t in texts]
        known = self.cache
        fresh = list({w for ws in split for w in ws if w not in known})
        ids = dict(zip(fresh, self.merges.encode_words(fresh)))
        out = []
        for ws in split:
            row: list[int] = []
            for w in ws:
                row += known.get(w) or ids[w]
            out.append(row)
        if len(known) + len(ids) > CACHED_WORDS:
            known.clear()
        known.update((w, i) for w, i in ids.items() if len(w) <= CACHED_CHARS)
        return out


_encoders: dict[str, Encoder] = {}


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str = PATH) -> DataFrame:
    """df with the column `ids`: the token ids of `text` without special tokens.

    path: the vocabulary file; it is read on the driver and sent to the executors, its size
    is fixed by the vocabulary. Other columns pass through.
    """
    merges = Merges(path)
    sent = df.sparkSession.sparkContext.broadcast((merges.of_byte, merges.keys, merges.rank, merges.made, merges.size))

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _encoders:
            m = Merges.__new__(Merges)
            m.of_byte, m.keys, m.rank, m.made, m.size = sent.value
            _encoders[path] = Encoder(m)
        for s in batches:
            yield pd.Series(_encoders[path](list(s)), dtype=object)

    return df.withColumn(ids, run(F.col(text)))
