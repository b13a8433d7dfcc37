"""Encoding with a public byte-level BPE vocabulary by a hierarchical-bitmap rank queue.

A pre-token's symbols form a doubly linked list. Every adjacent pair that has a merge rank is queued in
the bucket of its rank; a three-level bitmap over the ranks finds the lowest filled bucket by
find-first-set. Entries whose symbols have since merged are stale and skipped. A merge costs constant
time whatever the length, so a pre-token of a million bytes takes linear time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
WORD = 64


class RankQueue:
    """Positions by rank; ``pop`` gives the leftmost position of the lowest rank."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}  # one bit per rank
        self.mid: dict[int, int] = {}  # one bit per word of low
        self.top = 0  # one bit per word of mid

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = divmod(rank, WORD)
        c, d = divmod(a, WORD)
        self.low[a] = self.low.get(a, 0) | (1 << b)
        self.mid[c] = self.mid.get(c, 0) | (1 << d)
        self.top |= 1 << c

    def lowest(self) -> int:
        """The lowest rank with entries, -1 if there is none."""
        if not self.top:
            return -1
        c = (self.top & -self.top).bit_length() - 1
        m = self.mid[c]
        a = c * WORD + (m & -m).bit_length() - 1
        w = self.low[a]
        return a * WORD + (w & -w).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """All positions of the rank, from left to right; its bucket is emptied."""
        positions = self.buckets.pop(rank)
        a, b = divmod(rank, WORD)
        self.low[a] &= ~(1 << b)
        if not self.low[a]:
            c, d = divmod(a, WORD)
            self.mid[c] &= ~(1 << d)
            if not self.mid[c]:
                self.top &= ~(1 << c)
        positions.sort()
        return positions


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the lowest-ranked adjacent pair merges first, the leftmost on ties."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the symbol that starts at each position; 0 once it was merged away
    before = list(range(-1, n - 1))
    queue = RankQueue()
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            queue.push(r, i)
    while (rank := queue.lowest()) >= 0:
        queued = queue.take(rank)
        for at, i in enumerate(queued):
            j = end[i]
            # stale: merged away, at the end, or its pair has another rank by now
            if not j or j >= n or get(piece[i : end[j]]) != rank:
                continue
            k = end[i] = end[j]
            end[j] = 0
            sooner = False  # a new pair comes before the rest of this bucket
            if k < n:
                before[k] = i
                r = get(piece[i : end[k]])
                if r is not None:
                    queue.push(r, i)
                    sooner = r <= rank
            h = before[i]
            if h >= 0:
                r = get(piece[h:k])
                if r is not None:
                    queue.push(r, h)
                    sooner |= r <= rank
            if sooner:
                for q in queued[at + 1 :]:
                    queue.push(rank, q)
                break
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class ByteBPE:
    """A ``.tiktoken`` vocabulary with its pre-token pattern. Strings of special tokens are ordinary text."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, remembered: int = 1 << 18):
        import regex

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern(folder)).findall
        self.remembered = remembered
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for an empty text or null."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = encode_piece(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= 64:
                    if len(known) >= self.remembered:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


def pattern(folder: str = TOKENIZERS) -> str:
    """The public pre-token pattern that comes with the vocabulary files."""
    import importlib.util
    import os

    spec = importlib.util.spec_from_file_location("_tokenizer_files", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


@lru_cache(maxsize=4)
def loaded(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> ByteBPE:
    """One encoder per worker process."""
    return ByteBPE(name, folder)


def encode_column(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, ids)`` for every row: whole texts, an empty list for empty and null ones. No shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(name, folder)
        for b in batches:
            yield pd.DataFrame({key: b[key], "ids": [bpe.encode(t) for t in b[text]]})

    return df.select(F.col(key), F.col(text)).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, tokens)`` for every row; 0 for empty and null texts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(name, folder)
        for b in batches:
            yield pd.DataFrame({key: b[key], "tokens": [bpe.count(t) for t in b[text]]})

    return df.select(F.col(key), F.col(text)).mapInPandas(run, f"`{key}` {kind}, tokens long")
