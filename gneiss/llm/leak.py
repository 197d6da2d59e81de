"""Evaluation passages inside a corpus (problem 8).

Method: pigeonhole edit matching. Every window of ``run`` words of a test item is cut
into ``budget + 1`` pieces; a text that holds the window with at most ``budget`` word
edits holds one of the pieces unchanged. Exact hits of piece hashes give
alignments, and Myers' bit-parallel distance verifies them, in numpy for all
alignments of a batch at once. Documents are scanned where they lie: nothing
is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Words of items in one index, and indexes that a scan of the corpus holds.
ITEM_WORDS_AT_ONCE = 500_000
INDEXES_A_SCAN = 4
ALIGNMENTS_AT_ONCE = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_indexes: dict[str, list] = {}


def words_of(text: str | None) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n successive ids."""
    m = max(len(ids) - n + 1, 0)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : k + m].astype(np.uint64)) * _BASE
        h ^= h >> np.uint64(31)
    return h


def myers(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edit distance of each row of ``patterns`` to any substring of the same row of ``texts``.

    Rows are word ids; a pattern has at most 63 words. Bit k of the vectors stands for the
    pattern's first k + 1 words.
    """
    n, m = patterns.shape
    bits = np.uint64(1) << np.arange(m, dtype=np.uint64)
    last, one = np.uint64(1 << (m - 1)), np.uint64(1)
    up, down = np.full(n, (1 << m) - 1, np.uint64), np.zeros(n, np.uint64)
    score = np.full(n, m)
    best = score.copy()
    for j in range(texts.shape[1]):
        eq = ((patterns == texts[:, j : j + 1]) * bits).sum(axis=1, dtype=np.uint64)
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        higher, lower = down | ~(diagonal | up), up & diagonal
        score += ((higher & last) != 0).astype(int) - ((lower & last) != 0)
        higher, lower = higher << one, lower << one
        up, down = lower | ~(vertical | higher), higher & vertical
        best = np.minimum(best, score)
    return best


class Items:
    """Test items as one array of word ids with an index of their pieces."""

    def __init__(self, ids: list[int], texts: list[list[str]], run: int, budget: int):
        self.run, self.budget, self.piece = run, budget, run // (budget + 1)
        self.vocabulary: dict[str, int] = {}
        numbers, starts, item = [], [], []
        for i, words in enumerate(texts):
            starts.append(len(numbers))
            numbers += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            item += [i] * len(words)
        self.item_ids = np.array(ids, np.int64)
        self.words, self.item = np.array(numbers, np.int64), np.array(item, np.int64)
        self.ends = np.array(starts[1:] + [len(numbers)], np.int64)
        windows = np.flatnonzero(np.arange(len(numbers)) + run <= self.ends[self.item]) if numbers else np.zeros(0, np.int64)
        h = gram_hashes(self.words, self.piece)
        # one entry per window and piece: the piece's hash, the window's start and the piece's place in it
        place = np.repeat(np.arange(budget + 1) * self.piece, len(windows))
        window = np.tile(windows, budget + 1)
        key = h[window + place]
        order = np.argsort(key, kind="stable")
        self.window, self.place = window[order], place[order]
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)

    def alignments(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window start, text start) of the piece hits in a text of word ids, -1 for foreign words; in blocks."""
        if not len(self.keys):
            return
        foreign = np.r_[0, np.cumsum(ids < 0)]
        m = max(len(ids) - self.piece + 1, 0)
        at = np.flatnonzero(foreign[self.piece : self.piece + m] == foreign[:m])
        h = gram_hashes(ids, self.piece)[at]
        slot = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[slot] == h
        at, slot = at[hit], slot[hit]
        block = np.cumsum(self.count[slot]) // ALIGNMENTS_AT_ONCE
        for b in np.unique(block):
            p, s = at[block == b], slot[block == b]
            n = self.count[s]
            entry = np.repeat(self.first[s] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            both = np.stack([self.window[entry], np.repeat(p, n) - self.place[entry]], axis=1)
            both = np.unique(both, axis=0)
            yield both[:, 0], both[:, 1]


def _scan(items: Items, doc_ids: np.ndarray, texts: list[str | None]) -> pd.DataFrame:
    """item_id, doc_id, windows, exact_windows, distance of every document that holds a window within the budget."""
    know = items.vocabulary.get
    gap = items.run + 2 * items.budget  # keeps documents apart
    ids, owner = [], []
    for i, t in enumerate(texts):
        found = [know(w, -1) for w in words_of(t)]
        if len(found) >= items.run - items.budget:
            ids += [-2] * gap + found
            owner.append((len(ids), i))
    ids = np.array(ids + [-2] * gap, np.int64)
    out = []
    if owner:
        ends, docs = np.array([e for e, _ in owner]), np.array([i for _, i in owner])
        for window, start in items.alignments(ids):
            patterns = items.words[window[:, None] + np.arange(items.run)]
            reach = np.arange(-items.budget, items.run + items.budget)
            around = np.clip(start[:, None] + reach, 0, len(ids) - 1)
            distance = myers(patterns, ids[around])
            near = distance <= items.budget
            window, start, distance = window[near], start[near], distance[near]
            # a window's hit lies where its text does; a start before the first word belongs to the document after the gap
            doc = docs[np.minimum(np.searchsorted(ends, start + items.run // 2, side="right"), len(docs) - 1)]
            out.append(pd.DataFrame({"item": items.item[window], "doc": doc, "window": window, "distance": distance}))
    if not out:
        return pd.DataFrame({"item_id": [], "doc_id": [], "windows": [], "exact_windows": [], "distance": []}).astype("int64")
    hits = pd.concat(out).groupby(["item", "doc", "window"], as_index=False)["distance"].min()
    hits["exact"] = hits["distance"] == 0
    per = hits.groupby(["item", "doc"], as_index=False).agg(
        windows=("window", "size"), exact_windows=("exact", "sum"), distance=("distance", "min")
    )
    return pd.DataFrame(
        {
            "item_id": items.item_ids[per["item"]],
            "doc_id": doc_ids[per["doc"]],
            "windows": per["windows"],
            "exact_windows": per["exact_windows"],
            "distance": per["distance"],
        }
    ).astype("int64")


def _held(sent, key: str, run: int, budget: int) -> list[Items]:
    """The indexes of a scan, built once per worker process."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = [Items(*group, run, budget) for group in sent.value]
    return _indexes[key]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    run: int = 10,
    budget: int = 1,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """item_id, doc_id, windows, exact_windows, distance, n_windows.

    One row for each item and document where the document holds one of the item's windows of
    ``run`` words with at most ``budget`` words inserted, deleted or replaced: how many of its ``n_windows``
    it holds, how many of them word for word, and the least distance. Null and empty
    texts and items of fewer than ``run`` words have no window; ids are integers, an id
    should be unique, null ids are left out; documents of any length are read whole. Items are
    sent to the executors in groups of a bounded number of words, each item whole; one scan of the corpus serves INDEXES_A_SCAN groups.
    """
    source = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    groups: list[tuple[list[int], list[list[str]]]] = [([], [])]
    size = 0
    for row in items.filter(F.col(item_id).isNotNull()).select(item_id, text).toLocalIterator():
        words = words_of(row[1])
        if len(words) < run:
            continue
        if size + len(words) > ITEM_WORDS_AT_ONCE and groups[-1][0]:
            groups.append(([], []))
            size = 0
        groups[-1][0].append(row[0])
        groups[-1][1].append(words)
        size += len(words)
    out = None
    for lo in range(0, len(groups), INDEXES_A_SCAN):
        sent, key = spark.sparkContext.broadcast(groups[lo : lo + INDEXES_A_SCAN]), uuid.uuid4().hex

        def batches(it: Iterator[pd.DataFrame], sent=sent, key=key) -> Iterator[pd.DataFrame]:
            held = _held(sent, key, run, budget)
            for pdf in it:
                for k in range(0, len(pdf), 1000):
                    part = pdf.iloc[k : k + 1000]
                    for index in held:
                        yield _scan(index, part["doc_id"].to_numpy(), part["text"].tolist())

        schema = "item_id bigint, doc_id bigint, windows bigint, exact_windows bigint, distance bigint"
        found = source.mapInPandas(batches, schema)
        out = found if out is None else out.unionByName(found)
    n = [(i, len(t) - run + 1) for ids, texts in groups for i, t in zip(ids, texts)]
    sizes = spark.createDataFrame(pd.DataFrame(n, columns=["item_id", "n_windows"]).astype("int64"), "item_id bigint, n_windows bigint")
    return out.join(F.broadcast(sizes), "item_id")  # as bounded as the items above
