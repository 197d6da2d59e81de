"""Rows of evaluation splits that occur, exactly or almost, in the training split (problem 6).

Method: hashed n-grams over a record's fields. The fields fall into
``max_diff + 1`` fixed runs; records that differ in at most ``max_diff`` fields agree in all
fields of one run at least (pigeonhole), so each run is one n-gram whose hash
both records share. Training is scanned for the evaluation records' hashes,
and every hit is compared field by field.

Numbers agree within a relative tolerance. A number's token is its sign and its
logarithm's bucket; an evaluation record also probes the bucket beyond a
boundary nearer than the tolerance, so no agreeing pair is lost.

A hash that many records share (runs of zeros or missing values) would pair them
all. Such hot hashes are never paired as they are: the pigeonhole applies
again to the other fields, and each hot hash is extended by each of
``max_diff + 1`` runs of those, which loses nothing and tells the records apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.clean import finite, norm_label, quoted
from gneiss.plans.scratch import broadcast_if, keyed_join, materialize

WIDTH = 0.5
HOT_PAIRS = 2000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _chain(h: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Next link of a 64-bit hash chain."""
    h = (h ^ token.astype(np.uint64)) * _MIX
    return h ^ (h >> np.uint64(29))


def _tokens(v: np.ndarray, rel_tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Each number's token, and the one other token that an agreeing number may have (or the same)."""
    reach = -math.log(1 - rel_tol) * 1.01
    plain = np.isfinite(v) & (v != 0)
    ln = np.log(np.abs(np.where(plain, v, 1.0)))
    sign = np.where(v < 0, -(1 << 20), 1 << 20)
    edge = np.where(np.isfinite(v), 1, 0)
    here, down, up = (np.where(plain, sign + np.floor((ln + x) / WIDTH), edge).astype(np.int64) for x in (0, -reach, reach))
    return here, np.where(down != here, down, up)


class Fields:
    """The compared fields of a record and their runs.

    A prepared row has ``id``, ``nums`` (finite numbers, else null) and ``texts`` (categories, then the label).
    """

    def __init__(self, num_cols: list[str], cat_cols: list[str], label: str, max_diff: int, rel_tol: float):
        self.num, self.cat, self.label, self.rel_tol = num_cols, cat_cols, label, rel_tol
        self.width, self.parts = len(num_cols) + len(cat_cols) + 1, max_diff + 1
        self.runs = [list(range(i, self.width, self.parts)) for i in range(self.parts)]

    def rest(self, run: int) -> list[list[int]]:
        """The runs into which all other fields fall once ``run`` is hot."""
        others = [n for i, r in enumerate(self.runs) if i != run for n in r]
        return [others[i :: self.parts] for i in range(self.parts)]

    def select(self, df: DataFrame, id_col: str) -> DataFrame:
        texts = [*[quoted(c) for c in self.cat], norm_label(quoted(self.label))]
        return df.select(
            quoted(id_col).alias("id"),
            F.array(*[finite(quoted(c)) for c in self.num]).alias("nums"),
            F.array(*texts).alias("texts"),
        )

    def records(self, df: DataFrame, id_col: str) -> DataFrame:
        """id and two hashes of the whole record; nulls are told apart by their place."""
        nums = [F.coalesce(finite(quoted(c)), F.lit(float("nan"))) for c in self.num]
        texts = [t for c in [*[quoted(c) for c in self.cat], norm_label(quoted(self.label))] for t in (F.coalesce(c, F.lit("")), c.isNull())]
        return df.select(quoted(id_col).alias("id"), F.xxhash64(*nums, *texts).alias("r1"), F.xxhash64(F.lit(1), *nums, *texts).alias("r2"))

    def hashed(self, df: DataFrame, probing: bool, extend: bool) -> DataFrame:
        """id, key and, with ``extend``, the key's extensions by each run of the other fields.

        A row gives one key per run; with ``probing`` one per token that an agreeing record may have.
        """
        n_num, runs, rel_tol = len(self.num), self.runs, self.rel_tol
        rests = [self.rest(i) for i in range(self.parts)]
        flat = df.select(
            "id",
            *[F.get("nums", F.lit(i)).alias(f"f{i}") for i in range(n_num)],
            *[F.xxhash64(F.get("texts", F.lit(i))).alias(f"f{n_num + i}") for i in range(self.width - n_num)],
        )

        def grown(at: np.ndarray, h: np.ndarray, fields: list[int], tokens: dict) -> tuple[np.ndarray, np.ndarray]:
            for n in fields:
                here, other = tokens[n]
                base, h = h, _chain(h, here[at])
                if probing and other is not None and (more := here[at] != other[at]).any():
                    h = np.concatenate([h, _chain(base[more], other[at[more]])])
                    at = np.concatenate([at, at[more]])
            return at, h

        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                ids = pdf["id"].to_numpy()
                tokens = {}
                for n in range(pdf.shape[1] - 1):
                    v = pdf[f"f{n}"].to_numpy()
                    tokens[n] = _tokens(v.astype(float), rel_tol) if n < n_num else (v, None)
                for i, run in enumerate(runs):
                    start = np.full(len(ids), i + 1, np.uint64)
                    at, h = grown(np.arange(len(ids)), start, run, tokens)
                    if not extend:
                        yield pd.DataFrame({"id": ids[at], "key": h.astype(np.int64)})
                        continue
                    for k, rest in enumerate(rests[i]):
                        own, longer = grown(np.arange(len(at)), _chain(h, np.full(len(h), k)), rest, _Taken(tokens, at))
                        yield pd.DataFrame(
                            {"id": ids[at[own]], "key": h[own].astype(np.int64), "longer": longer.astype(np.int64)}
                        )

        kind = dict(df.dtypes)["id"]
        return flat.mapInPandas(batches, f"id {kind}, key bigint" + ", longer bigint" * extend)


class _Taken:
    """Tokens of the rows at ``at``."""

    def __init__(self, tokens: dict, at: np.ndarray):
        self.tokens, self.at = tokens, at

    def __getitem__(self, n: int) -> tuple[np.ndarray, np.ndarray | None]:
        here, other = self.tokens[n]
        return here[self.at], None if other is None else other[self.at]


def _differences(rel_tol: float) -> Column:
    """Number of fields in which the rows (x_nums, x_texts) and (y_nums, y_texts) differ."""

    def far(x: Column, y: Column) -> Column:
        close = F.coalesce(F.abs(x - y) <= rel_tol * F.greatest(F.abs(x), F.abs(y)), F.lit(False))
        return ~(close | (x.isNull() & y.isNull()))

    nums = F.zip_with("x_nums", "y_nums", far)
    texts = F.zip_with("x_texts", "y_texts", lambda x, y: ~x.eqNullSafe(y))
    return F.size(F.filter(F.concat(nums, texts), lambda d: d))


def near_rows(
    rows: DataFrame,
    num_cols: list[str],
    cat_cols: list[str],
    label: str,
    *,
    id_col: str = "row_id",
    max_diff: int = 2,
    rel_tol: float = 0.01,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """train_id, eval_id, n_diff of every train row and val or test row that differ in at most ``max_diff`` fields.

    Missing numbers (null, NaN, infinite) agree with missing ones only, categories as
    stored, the label without case and outer blanks. Rows repeated under one id count once,
    rows with a null id or split take no part, and empty tables give an empty table.
    Only the named columns are read. ``hot_pairs`` is the number of pairs from which a
    shared hash is extended instead of paired; it changes the work, never the result.
    """
    f = Fields(num_cols, cat_cols, label, max_diff, rel_tol)
    rows = rows.filter(quoted(id_col).isNotNull())
    train, train_copies = _distinct(f, rows.filter(F.col("split") == "train"), id_col)
    held, held_copies = _distinct(f, rows.filter(F.col("split").isin("val", "test")), id_col)
    tk = materialize(f.hashed(train, False, False))
    ek = materialize(f.hashed(held, True, False))
    sizes = tk.groupBy("key").agg(F.count_distinct("id").alias("t")).join(
        ek.groupBy("key").agg(F.count_distinct("id").alias("e")), "key"
    )
    hot = materialize(sizes.filter(F.col("t") * F.col("e") > hot_pairs).select("key"))
    n_hot = hot.count()
    if n_hot:
        no = broadcast_if(hot, n_hot, 16)

        def refined(plain: DataFrame, side: DataFrame, probing: bool) -> DataFrame:
            longer = f.hashed(side, probing, True).join(no, "key", "left_semi")
            cold = plain.join(no, "key", "left_anti").select("id", "key")
            return cold.unionByName(longer.select("id", F.col("longer").alias("key")))

        tk, ek = refined(tk, train, False), refined(ek, held, True)
    pairs = tk.select("key", F.col("id").alias("train_id")).join(ek.select("key", F.col("id").alias("eval_id")), "key")
    pairs = materialize(pairs.select("train_id", "eval_id").distinct())

    def side(df: DataFrame, name: str, prefix: str) -> DataFrame:
        return df.select(
            F.col("id").alias(name), F.col("nums").alias(f"{prefix}_nums"), F.col("texts").alias(f"{prefix}_texts")
        )

    hits = pairs.join(side(held, "eval_id", "x"), "eval_id").join(side(train, "train_id", "y"), "train_id")
    hits = hits.select("train_id", "eval_id", _differences(rel_tol).alias("n_diff")).filter(F.col("n_diff") <= max_diff)
    hits = materialize(hits.groupBy("train_id", "eval_id").agg(F.min("n_diff").alias("n_diff")))
    for name, copies in (("train_id", train_copies), ("eval_id", held_copies)):
        every = copies.select(F.col("first").alias(name), F.col("id").alias("_copy"))
        more = hits.join(every, name).drop(name).withColumnRenamed("_copy", name)
        hits = hits.unionByName(more.select(*hits.columns))
    return hits


def _distinct(f: Fields, rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(the fields of ``rows`` with one row of every record, by its smallest id; (first, id) of the other ids of each record).

    Only hashes and ids are shuffled. Records that many ids hold are compared once, and their pairs are made at the end.
    """
    keys = f.records(rows, id_col)
    shared = keys.groupBy("r1", "r2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = materialize(shared.filter("first <> last").select("r1", "r2", "first", "n"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copies = keyed_join(keys, shared, ["r1", "r2"], "n", total).filter("id <> first")
    copies = materialize(copies.select("first", "id").distinct())
    return f.select(rows, id_col).join(broadcast_if(copies.select("id"), total, 16), "id", "left_anti"), copies
