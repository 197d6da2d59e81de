"""The k most similar vectors of every vector (problem 4).

Method: hash-prefix forest. In each tree a vector is a long string of bits, the sides of random planes on which it lies, and the tree
is the array of all strings in sorted order. A vector descends to its longest-prefix matches in all trees of a task, then ascends
them together, one bit of prefix at a time, until the matches of all trees are ``want`` candidates a tree; a few strings
before and after a run are candidates too. Where half of the trees finds little of what the other half does, as in a dense group
without structure, it ascends on. Candidates are ranked by exact distance and id.

The first bits of a tree are the sides of planes through the median of a bounded sample, so they part any group of distinct vectors
evenly, however dense. They send every vector to one task per tree (a leaf of about ``leaf`` vectors), where
the rest of the tree lives in memory: ``local`` arrays of strings that share those first bits. The index covers every vector;
only the planes are fitted on the sample (SAMPLE rows a tree, parting up to SAMPLE / 16 leaves; in a larger table leaves grow).

Planes through a leaf's mean hardly part a dense group. Where a run of equal strings is longer than ``want``, its strings go on with
the sides about the run's mean, and so on. Signs about a mean can't all be alike, so every round parts each run. A run
of vectors that are all at distance 0 after rounding is not parted: its members' nearest are its smallest ids (of the leaf's, where
such a run is larger than a leaf).

Equal directions are one entry of the index and bring along their smallest ids, so copies can't crowd each other out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.vectors import direction, directions, matrix, shared_directions
from gneiss.plans.scratch import keyed_join, materialize

TREES = 4
LOCAL = 4
WANT = 300
LEAF = 65_536
SAMPLE = 32_768
BITS = 63
#: Strings before and after a run that are candidates too.
BESIDE = 32
#: Where the halves of a leaf's trees agree on less of what they find, the ascent goes on to four times the candidates.
AGREED = 0.15
AROUND = 64
#: Distances worked out at once.
CELLS = 1 << 20
#: Squared extent below which every pair of a run is at a distance that rounds to 0.
TIGHT = 9e-10
NEAR = "array<struct<dist:double,id:bigint>>"


class Top:
    """The first bits of a tree: a binary tree of planes through the sample's medians."""

    def __init__(self, sample: np.ndarray, leaves: float, rng: np.random.Generator):
        self.planes, self.levels, self.next = [], [], []
        self.root = self._part(sample, min(leaves, len(sample) / 16), rng)
        self.n = max(len(self.planes) + 1, 1)

    def _part(self, x: np.ndarray, leaves: float, rng: np.random.Generator) -> int:
        """Number of the node made, negative for a leaf."""
        plane = rng.standard_normal(x.shape[1])
        side = x @ plane
        level = float(np.median(side)) if len(side) else 0.0
        if leaves <= 1 or not 0 < (side <= level).sum() < len(side):
            return -1
        me = len(self.planes)
        self.planes.append(plane)
        self.levels.append(level)
        self.next.append((-1, -1))
        self.next[me] = self._part(x[side <= level], leaves / 2, rng), self._part(x[side > level], leaves / 2, rng)
        return me

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """A number of each row's leaf: its path's last node, twice, and the side."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)), 0)]
        while todo:
            node, rows, name = todo.pop()
            if node < 0:
                out[rows] = name
                continue
            low = x[rows] @ self.planes[node] <= self.levels[node]
            todo += [(self.next[node][s], rows[low == (s == 0)], 2 * node + 2 + s) for s in (0, 1)]
        return out


def _strings(unit: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Rows in the order of their strings, the length of the prefix each string shares with the one before (-1 for the first), and tight runs."""
    order, shared = np.arange(len(unit)), np.full(len(unit), -1, np.int64)
    tight, todo = [], [(0, len(unit), 0)]
    weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    while todo:
        lo, hi, length = todo.pop()
        x = unit[order[lo:hi]]
        if length and ((x.max(axis=0) - x.min(axis=0)) ** 2).sum() < TIGHT:
            tight.append((lo, hi))
            continue
        key = ((x - x.mean(axis=0)) @ rng.standard_normal((x.shape[1], BITS)) > 0) @ weight
        by = np.argsort(key, kind="stable")
        order[lo:hi], key = order[lo:hi][by], key[by]
        # bits from the first difference on
        rest = np.frexp((key[1:] ^ key[:-1]).astype(float))[1]
        rest = np.where(key[1:] >> np.maximum(rest - 1, 0) == key[:-1] >> np.maximum(rest - 1, 0), rest - 1, rest)
        shared[lo + 1 : hi] = length + BITS - np.maximum(rest, 0)
        edges = np.r_[lo, lo + 1 + np.flatnonzero(shared[lo + 1 : hi] < length + BITS), hi]
        todo += [(int(edges[i]), int(edges[i + 1]), length + BITS) for i in np.flatnonzero(np.diff(edges) > limit)]
    return order, shared, tight


def _kept(rows: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (row, key) the ``k`` smallest different keys of each row, by row and key."""
    row, key = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.r_[True, (np.diff(row) != 0) | (np.diff(key) != 0)][: len(row)]
    row, key = row[new], key[new]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], key[keep]


def _unsettled(halves: list[tuple[np.ndarray, np.ndarray]], n: int, order: np.ndarray) -> np.ndarray:
    """Rows in whose surroundings the two halves of the trees find too few neighbours in common.

    Two independent searches that both find a share r of the true neighbours agree on about r / (2 - r) of what they find together. The
    shares are averaged over AROUND rows that follow each other in ``order``, as like rows do.
    """
    row, key = (np.concatenate(x) for x in zip(*halves))
    by = np.lexsort((key, row))
    row, key = row[by], key[by]
    again = row[1:][(np.diff(row) == 0) & (np.diff(key) == 0)]
    both = np.bincount(again, minlength=n)
    union = np.bincount(row, minlength=n) - both
    window = np.ones(min(AROUND, n))
    common, found = (np.convolve(x[order].astype(float), window, "same") for x in (both, union))
    out = np.zeros(n, bool)
    out[order] = common < AGREED * found
    return out


def search(unit: np.ndarray, k: int, max_dist: float, *, local: int = LOCAL, want: int = WANT, beside: int = BESIDE, seed: object = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, row of a neighbour and distance for up to ``k`` neighbours of every row of a leaf, nearest first, equal distances by row."""
    n = len(unit)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if n < 2:
        return none
    rng = np.random.default_rng(seed)
    trees = [_strings(unit, want, rng) for _ in range(local)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # a distance in units of 1e-9 and a row make one key, so ties fall to the smaller row
    most = int(round(min(max_dist, 2.0) * 1e9))
    done_by = [np.zeros(n, bool) for _ in range(local)]
    for (order, _, tight), done in zip(trees, done_by):
        for lo, hi in tight:
            run = np.sort(order[lo:hi])
            first, done[order[lo:hi]] = run[: k + 1], True
            row, other = np.repeat(run, len(first)), np.tile(first, len(run))
            dist = np.rint(np.maximum(1 - np.einsum("ij,ij->i", unit[row], unit[other]), 0) * 1e9).astype(np.int64)
            keep = (row != other) & (dist <= most)
            found.append((row[keep], (dist[keep] << 32) | other[keep]))
    place = [np.argsort(order) for order, _, _ in trees]

    def ascend(waiting: np.ndarray, enough: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """(row, key) from each tree for the waiting rows, each at the longest prefix at which all trees have ``enough`` candidates a tree."""
        out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in trees]
        level = max(int(shared.max()) for _, shared, _ in trees)
        while waiting.any():
            level = max(level, 0)
            runs = [np.r_[0, np.flatnonzero(shared[1:] < level) + 1, n] if level else np.array([0, n]) for _, shared, _ in trees]
            mine = [np.searchsorted(r, np.arange(n), side="right") - 1 for r in runs]
            total = sum(np.diff(r)[m][p] for r, m, p in zip(runs, mine, place))
            now = waiting & (total >= enough * local) if level else waiting.copy()
            for (order, _, _), edges, run, done, got in zip(trees, runs, mine, done_by, out):
                at = np.flatnonzero((now & ~done)[order]) if now.any() else np.zeros(0, np.int64)
                cuts = np.r_[0, np.flatnonzero(np.diff(run[at])) + 1, len(at)] if len(at) else [0]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    lo, hi = max(edges[run[at[a]]] - beside, 0), min(edges[run[at[a]] + 1] + beside, n)
                    others = order[lo:hi]
                    near = unit[others].T
                    step = max(1, CELLS // len(others))
                    for c in range(a, b, step):
                        ask = at[c : min(c + step, b)]
                        key = np.rint(np.maximum(1 - unit[order[ask]] @ near, 0) * 1e9).astype(np.int64)
                        key[np.arange(len(ask)), ask - lo] = 2_000_000_001  # beyond any distance
                        key = (key << 32) | others
                        if key.shape[1] > k:
                            key = np.partition(key, k - 1, axis=1)[:, :k]
                        row = np.repeat(order[ask], key.shape[1])
                        key = key.ravel()
                        keep = key >> 32 <= most
                        got.append((row[keep], key[keep]))
            waiting = waiting & ~now
            level -= 1
        return out

    waiting, enough = np.ones(n, bool), want
    while waiting.any():
        got = ascend(waiting, enough)
        halves = [_kept([rows for tree in got[i::2] for rows in tree], k) for i in (0, 1) if any(got[i::2])]
        found += halves
        if len(halves) < 2 or enough >= n:
            break
        waiting &= _unsettled(halves, n, trees[0][0])
        enough *= 4
    if not found:
        return none
    row, key = _kept(found, k)
    return row, key & 0xFFFFFFFF, (key >> 32) / 1e9


def _routed(classes: DataFrame, dims: int, trees: int, leaf: int, seed: int) -> tuple[DataFrame, int]:
    """leaf, id, unit, members: every vector once per tree, and the number of leaves of all trees."""
    n = classes.count()
    drawn = classes.select("unit").orderBy(F.xxhash64("id"), "id").limit(SAMPLE if n > leaf else 0)
    sample = matrix(drawn.toArrow().column("unit"), dims)
    tops = [Top(sample, n / leaf, np.random.default_rng((seed, t))) for t in range(trees)]
    sent = classes.sparkSession.sparkContext.broadcast(tops)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = matrix(b.column("unit"), dims)
            for t, top in enumerate(sent.value):
                yield pa.RecordBatch.from_arrays([pa.array(top.leaf(x) * trees + t), *b.columns], ["leaf", "id", "unit", "members"])

    routed = classes.select("id", "unit", "members").mapInArrow(batches, "leaf bigint, id bigint, unit binary, members array<bigint>")
    return routed, sum(t.n for t in tops)


def class_neighbours(
    classes: DataFrame, dims: int, k: int, *, max_dist: float = 2.0, trees: int = TREES, leaf: int = LEAF, local: int = LOCAL, want: int = WANT, seed: int = 7
) -> DataFrame:
    """id, near: up to ``k`` + 1 nearest points of every direction as structs (dist, id), its own members at distance 0 among them.

    ``classes`` has id, unit and members, one row per direction.
    """

    def answer(held: list[pa.RecordBatch], name: int) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks().sort_by("id")  # rows in the order of ids
        ids, unit = whole.column("id").to_numpy(), matrix(whole.column("unit"), dims)
        members = whole.column("members").combine_chunks()
        member, first = members.flatten().to_numpy(), np.r_[0, np.cumsum(members.value_lengths().to_numpy())]
        row, other, dist = search(unit, k, max_dist, local=local, want=want, seed=(seed, name))
        shared = np.flatnonzero(np.diff(first) > 1)
        row, other, dist = np.r_[row, shared], np.r_[other, shared], np.r_[dist, np.zeros(len(shared))]
        width = first[other + 1] - first[other]
        near = member[np.repeat(first[other] - np.cumsum(width) + width, width) + np.arange(width.sum())]
        row, dist = np.repeat(row, width), np.repeat(dist, width)
        order = np.lexsort((near, dist, row))
        row, near, dist = row[order], near[order], dist[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k + 1
        row, near, dist = row[keep], near[keep], dist[keep]
        count = np.bincount(row, minlength=len(ids))
        some = np.flatnonzero(count)
        for lo in range(0, len(some), 4096):
            part = some[lo : lo + 4096]
            a, b = np.searchsorted(row, [part[0], part[-1] + 1])
            pair = pa.StructArray.from_arrays([pa.array(dist[a:b]), pa.array(near[a:b])], ["dist", "id"])
            ends = pa.array(np.r_[0, np.cumsum(count[part])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.ListArray.from_arrays(ends, pair)], ["id", "near"])

    def leaves(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in it:
            name = b.column("leaf").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(name)) + 1), len(name)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    if name[lo] != now:
                        yield from answer(held, now)
                        held, now = [], name[lo]
                    held.append(b.slice(lo, hi - lo))
        yield from answer(held, now)

    routed, n = _routed(classes, dims, trees, leaf, seed)
    tasks = max(2 * n, routed.sparkSession.sparkContext.defaultParallelism)
    near = routed.repartition(tasks, "leaf").sortWithinPartitions("leaf").mapInArrow(leaves, f"id bigint, near {NEAR}")
    merged = near.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return merged.select("id", F.slice(F.array_sort("near"), 1, k + 1).alias("near"))


def nearest(points: DataFrame, dims: int, k: int, *, max_dist: float = 2.0, **forest) -> DataFrame:
    """id, near: up to ``k`` nearest other points of every point as structs (dist, id), nearest first, ties by id.

    ``points`` are unit_points. Distances are 1 - cosine rounded to 9 decimals; neighbours beyond ``max_dist`` are
    left out, and a point without any has no row. A single point or an empty table gives no rows.
    """
    classes = materialize(directions(points, k + 1))
    near = class_neighbours(classes.select("id", "unit", "members"), dims, k, max_dist=max_dist, **forest)
    shared, many, total = shared_directions(points, 1)
    mine = F.slice(F.filter("near", lambda s: s["id"] != F.col("id")), 1, k)
    if not many:
        return near.select("id", mine.alias("near")).filter(F.size("near") > 0)
    near = materialize(near)
    # the other members of a direction read the list of its smallest id
    rest = keyed_join(points.select("id", *direction(F.col("unit"))), shared.select("d1", "d2", "n", F.col("id").alias("first")), ["d1", "d2"], "n", total)
    rest = rest.filter("id <> first").select("id", "first")
    lists = shared.select(F.col("id").alias("first"), "n").join(near.withColumnRenamed("id", "first"), "first")
    rest = keyed_join(rest, lists, ["first"], "n", total).select("id", "near")
    return near.select("id", "near").unionByName(rest).select("id", mine.alias("near")).filter(F.size("near") > 0)
