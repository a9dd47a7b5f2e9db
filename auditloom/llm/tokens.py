"""Byte-level BPE over whole columns by batched numpy merge rounds.

The words of many texts lie in one flat array of symbols.  Each round looks up
the ranks of all adjacent pairs by binary search over the sorted pair keys,
takes the lowest rank of each word and merges it everywhere in that word, until
no word has a pair left.  Words that are done leave the array.  A word is merged
once for each batch that has it, and not at all while it is in the cache.

Defined results: a null text has null ids and no tokens, an empty text has an
empty list; blank texts are encoded like any other.  Texts may have any length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The split of byte_bpe_50k (fixed value, part of the vocabulary's definition).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary lies unless a caller names another place.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words that a worker keeps encoded, and the longest (bytes) that it keeps.
CACHE_WORDS, CACHE_BYTES = 200_000, 64
#: Symbols that go into one merge at most, but for a single longer word.
FLAT_SYMBOLS = 4_000_000

_NONE = np.iinfo(np.int32).max


class Bpe:
    """The merges of one rank file as sorted pair keys."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.start = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        keys, to = [], []
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    to.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.to = np.array(keys, dtype=np.int64)[order], np.array(to, dtype=np.int32)[order]
        self.cache: dict[str, np.ndarray] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank, which is also the new symbol, of each pair, or _NONE."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.to[at], _NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (none empty)."""
        out: list[np.ndarray | None] = [None] * len(words)
        size = np.array([len(w) for w in words])
        at = 0
        while at < len(words):
            end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), FLAT_SYMBOLS, "right")))
            self._merge_flat(words[at:end], size[at:end], out, at)
            at = end
        return out

    def _merge_flat(self, words: list[bytes], size: np.ndarray, out: list, base: int) -> None:
        flat = self.start[np.frombuffer(b"".join(words), dtype=np.uint8)]
        who = np.repeat(np.arange(len(words)), size)  # the word of each symbol
        rank = np.full(len(flat), _NONE, dtype=np.int32)  # of the pair that begins here
        if len(flat) > 1:
            inside = who[:-1] == who[1:]
            rank[:-1] = np.where(inside, self.ranks_of(flat[:-1], flat[1:]), _NONE)
        while len(flat):
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(flat)])
            done = lowest == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[base + who[first[k]]] = flat[first[k] : first[k] + count[k]].copy()
                keep = np.repeat(~done, count)
                flat, who, rank = flat[keep], who[keep], rank[keep]
                lowest, count = lowest[~done], count[~done]
                if not len(flat):
                    return
            hit = np.flatnonzero(rank == np.repeat(lowest, count))
            # of overlapping pairs of one rank (aaa), every other one merges, from the left
            gap = np.diff(hit, prepend=-2) == 1
            if gap.any():
                run = np.flatnonzero(~gap)
                hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            flat[hit] = rank[hit]
            keep = np.ones(len(flat), dtype=bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))  # place of the merged symbols when the others are gone
            flat, who, rank = flat[keep], who[keep], rank[keep]
            # only the pairs at merged symbols are new
            touched = np.unique(np.r_[now, now[now > 0] - 1])
            rank[touched] = _NONE
            pair = touched[touched < len(flat) - 1]
            pair = pair[who[pair] == who[pair + 1]]
            rank[pair] = self.ranks_of(flat[pair], flat[pair + 1])

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text, None for None."""
        split = [None if t is None else self.split.findall(t) for t in texts]
        new = [w for w in dict.fromkeys(w for ws in split if ws for w in ws) if w not in self.cache]
        merged = dict(zip(new, self.merge([w.encode("utf-8", "surrogatepass") for w in new]))) if new else {}
        cache = self.cache
        none = np.empty(0, dtype=np.int32)
        out = [None if ws is None else np.concatenate([x if (x := merged.get(w)) is not None else cache[w] for w in ws]) if ws else none for ws in split]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        cache.update((w, ids) for w, ids in merged.items() if len(w) <= CACHE_BYTES)
        return out


@lru_cache(maxsize=2)
def bpe(path: str = VOCABULARY, pattern: str = PATTERN) -> Bpe:
    """One vocabulary for each worker."""
    return Bpe(path, pattern)


def token_ids(text: Column, path: str = VOCABULARY) -> Column:
    """``array<int>`` ids of a text column, without special tokens."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(bpe(path).encode([None if pd.isna(t) else t for t in batch]), index=batch.index, dtype=object)

    return ids(text)


def token_counts(text: Column, path: str = VOCABULARY) -> Column:
    """The number of tokens of a text column; 0 for null and empty texts."""

    @F.pandas_udf("int")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([0 if x is None else len(x) for x in bpe(path).encode([None if pd.isna(t) else t for t in batch])], index=batch.index)

    return counts(text)


def encode_table(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """``id_col, ids`` of every row of ``df``, in one pass without a shuffle."""
    return df.select(id_col, token_ids(F.col(text_col), path).alias("ids"))
