"""Token ids of every text by a public byte-level BPE vocabulary (problem 7).

Method: pair occurrence index. The distinct words of a partition become one array of
symbols with links to the next and previous symbol of the same word. An index
maps every adjacent pair that has a rank to all positions where it occurs; the
active ranks are applied in ascending order, each to all its positions at
once, and only the lists of the pairs that a merge touches are updated. A pair
made with a new symbol always has a higher rank than the pair that made the
symbol, so one ascending sweep equals merging every word on its own.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: The split of a text into words before any merge, as the vocabulary defines it; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS_AT_ONCE = 200_000

_mergers: dict = {}  # of this worker process


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is also the token's id, of a rank file (one base64 token and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, f))}


class Merger:
    """Splits words into tokens, many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = max(ranks.values()) + 1
        # every way to write a token as two tokens: (left id, right id) -> rank of the merge
        self.pair_rank: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None and left < rank and right < rank:
                    self.pair_rank[left * self.size + right] = rank
        keys = np.fromiter(self.pair_rank, np.int64, len(self.pair_rank))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.fromiter(self.pair_rank.values(), np.int64, len(keys))[order]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 without one."""
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.values[at], -1)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word; all words must be non-empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        nxt = np.arange(1, n + 1)
        prv = np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends - lengths] = -1
        alive = np.ones(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Index the pairs that start at ``at`` under the rank of their merge."""
            if not len(at):
                return
            rank = self._ranks(symbol[at], symbol[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, group in zip(rank[np.r_[0, cut]] if len(rank) else [], np.split(at, cut)):
                if (r := int(r)) in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(heap, r)

        note(np.flatnonzero(nxt >= 0))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(index.pop(rank)))
            # positions whose pair has changed since it was noted drop out
            at = at[alive[at] & (nxt[at] >= 0)]
            at = at[self._ranks(symbol[at], symbol[nxt[at]]) == rank]
            # in a run of overlapping pairs, as in aaaa, the left one goes first
            if len(at) > 1:
                follows = np.r_[False, nxt[at[:-1]] == at[1:]]
                if follows.any():
                    start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - start) % 2 == 0]
            right = nxt[at]
            symbol[at] = rank
            alive[right] = False
            nxt[at] = nxt[right]
            more = nxt[at] >= 0
            prv[nxt[at[more]]] = at[more]
            before = prv[at]
            note(np.unique(np.concatenate([at[more], before[before >= 0]])))
        counts = np.bincount(word[alive], minlength=len(words))
        return np.split(symbol[alive], np.cumsum(counts)[:-1])


def _merger(sent, key: str) -> Merger:
    """The vocabulary's merger, built once per worker process."""
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(sent.value)
    return _mergers[key]


def encode_texts(df: DataFrame, ranks: dict[bytes, int], *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ids (list of integers): the token ids of every text, without special tokens.

    Null and empty texts get an empty list; strings that look like special tokens are ordinary
    text; texts of any length are encoded whole; rows are kept as they come, repeats
    included; other columns are not read. ``ranks`` is the vocabulary, of fixed size, sent to the executors once.
    """
    sent, key = df.sparkSession.sparkContext.broadcast(ranks), uuid.uuid4().hex

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merger, split = _merger(sent, key), regex.compile(PATTERN)
        known: dict[str, np.ndarray] = {}

        def learn(words: Iterable[str]) -> None:
            fresh = [w for w in words if w not in known]
            if len(known) + len(fresh) > WORDS_AT_ONCE:
                known.clear()
                fresh = list(set(words))
            known.update(zip(fresh, merger.encode([w.encode("utf-8", "replace") for w in fresh])))

        for pdf in it:
            cut = [split.findall(t) if t else [] for t in pdf[text]]
            learn({w for words in cut for w in words})
            ids = [np.concatenate([known[w] for w in words]).astype(np.int32) if words else np.zeros(0, np.int32) for words in cut]
            yield pd.DataFrame({id_col: pdf[id_col], "ids": ids})

    return df.select(F.col(id_col), F.col(text)).mapInPandas(batches, f"{id_col} {dict(df.dtypes)[id_col]}, ids array<int>")
