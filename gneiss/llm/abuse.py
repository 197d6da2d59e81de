"""Abusive, hateful or sexual passages, scored by their nearest labelled examples (problem 9).

Method: every text is cut into short passages, and a passage's neighbours among the passages of rated
documents are found by exact TF-IDF cosine, using an inverted index with block
maxima: blocks of examples whose best possible cosine can't enter the result are
never read. Distance-weighted votes of the neighbours' ratings give a passage's score, the
neighbours are its evidence, and a document's score is that of its worst passage, calibrated on
the rated documents, each scored without its own passages.

Ratings are of documents, not of passages. A document rated abusive has at least one abusive passage, so its rating is
shared out among its passages by their neighbours in other documents (noisy-or, raters erring at
the rate at which they contradict each other). A passage that ends without a share is no evidence of abuse, and a passage without
an abusive example within ``FLOOR`` has vote 0, so only those near one need all of their neighbours.

The index is fitted on a bounded sample of rated documents (``max_rated``, ``max_passages``); term
statistics cover all passages of all documents, and every passage of every text is scored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.plans.scratch import discard, keyed_join, materialize

MAX_RATED = 20_000
MAX_PASSAGES = 400_000
NEIGHBOURS = 25
FLOOR = 0.4
DRAW = 0.1
#: Shares below this count as none.
LEAST_SHARE = 0.2
#: What the terms of a query left out of the first look may add to a cosine.
SLACK = 0.1
BLOCK = 16
QUERIES = 256
LONG, STEP = 30, 15
SPELLINGS = 200_000

#: Letters of other scripts that pass for Latin ones, and digits and signs that pass for letters; fixed values.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁɡαεικνορτυχ", "abekmhopctyxijsdgaeiknoptux")
LEET = str.maketrans("013457@$!", "oieastasi")

_SENTENCE = re.compile(r"(?<=[.!?…])[\s\"'»”)]+|[\n\r\t\x0b\x0c]+")
_SPELT = re.compile(r"(?<![^\W_])([^\W\d_](?:([ ._*\-])[^\W\d_])(?:\2[^\W\d_])+)(?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_NAMED = re.compile(r"(?<![^\W\d_])[^\W\d_]+-\d+")
_LEETED = re.compile(r"(?<![^\W_])(?:[a-z]+[013457@$!]+(?=[a-z])|[@$](?=[a-z]))[a-z013457@$!]*")
_UNSEEN = regex.compile(r"[\p{Cf}\p{Mn}]+")
_WORD = re.compile(r"[^\W_]+|#")
_MIXED = re.compile(r"(?:[a-z][а-яіјѕα-ω]|[а-яіјѕα-ω][a-z])")


def _words(token: str) -> list[str]:
    """The words of a stretch of text without blanks, with disguises undone: look-alike letters, digits for letters, stretched words; numbers become #."""
    if not token.isascii():
        token = re.sub(r"[^\W\d_]+", lambda m: m[0].translate(LOOKALIKES) if _MIXED.search(m[0]) else m[0], token)
    token = _NAMED.sub("#", token)
    token = _LEETED.sub(lambda m: m[0].translate(LEET), token)
    token = _STRETCHED.sub(r"\1", token)
    return ["#" if any(c.isdigit() for c in w) else w for w in _WORD.findall(token)]


def cutter() -> Callable[[str | None], list[str]]:
    """A function from a text to its distinct passages as strings of plain words: its sentences, long ones in overlapping windows.

    Each spelling is worked out once and kept, up to a bound on memory.
    """
    known: dict[str, list[str]] = {}

    def passages(text: str | None) -> list[str]:
        text = text or ""
        if not text.isascii():
            text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
        text = _SPELT.sub(lambda m: m[0].replace(m[2], ""), text.lower())
        out: dict[str, None] = {}
        for part in _SENTENCE.split(text):
            words: list[str] = []
            for token in part.split():
                plain = known.get(token)
                if plain is None:
                    if len(known) >= SPELLINGS:
                        known.clear()
                    plain = known[token] = _words(token)
                words += plain
            if words:
                for i in range(0, max(1, len(words) - LONG + STEP) if len(words) > LONG else 1, STEP):
                    out[" ".join(words[i : i + LONG])] = None
        return list(out)

    return passages


def passages(text: str | None) -> list[str]:
    return cutter()(text)


def terms(passage: str) -> Counter:
    """Words and pairs of successive words."""
    words = passage.split(" ")
    return Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


#: terms() as an expression over ``passage``, each term once.
_TERMS = """array_distinct(concat(split(passage, ' '),
    transform(sequence(1, greatest(size(split(passage, ' ')) - 1, 1)),
      i -> if(i < size(split(passage, ' ')), concat_ws(' ', slice(split(passage, ' '), i, 2)), split(passage, ' ')[0]))))"""


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (np.asarray(df, float) + 0.5))


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges lo..hi one after another, and the ranges' widths."""
    width = hi - lo
    return np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum()), width


class Space:
    """Terms of the examples with their weights."""

    def __init__(self, vocabulary: list[str], df: np.ndarray, n: int):
        self.at = {t: i for i, t in enumerate(vocabulary)}
        self.idf = idf(df, n)

    def vectors(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[str, int]]]]:
        """Row, term and weight of the known terms, by row, and each row's unknown terms with their counts."""
        row, at, tf, unknown = [], [], [], []
        for i, p in enumerate(batch):
            rest = []
            for t, c in terms(p).items():
                j = self.at.get(t)
                if j is None:
                    rest.append((t, c))
                else:
                    row.append(i)
                    at.append(j)
                    tf.append(c)
            unknown.append(rest)
        term = np.array(at, np.int64)
        return np.array(row, np.int64), term, (1 + np.log(np.array(tf, float))) * self.idf[term], unknown


class Index:
    """Vectors in blocks under an inverted index: the largest weight of a term in every block, then the weights themselves."""

    def __init__(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        """``row`` (rising), ``at``, ``weight``: the entries of ``n`` vectors over ``n_terms`` terms. Like neighbours in order make tight bounds."""
        self.n, self.n_blocks = n, -(-n // BLOCK)
        self.at, self.weight, self.starts = at, weight, np.searchsorted(row, np.arange(n + 1))
        order = np.lexsort((row, at))
        term, member, w = at[order], row[order], weight[order]
        block = member // BLOCK
        first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(block) != 0)][: len(term)])
        self.member, self.member_weight = member % BLOCK, w
        self.post_block, self.post_end = block[first], np.r_[first, len(term)]
        self.post_max = np.maximum.reduceat(w, first) if len(first) else w
        self.post_start = np.searchsorted(term[first], np.arange(n_terms + 1))
        self.top = np.zeros(n_terms)
        np.maximum.at(self.top, at, weight)
        self.column = np.full(n_terms, -1, np.int64)

    def nearest(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int, k: int = NEIGHBOURS, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, vector and cosine of each query's ``k`` largest cosines of at least ``floor``, largest first, ties by number; exact.

        Terms that can add no more than SLACK in all are left out at first. Blocks whose bound is below the floor are
        not opened; in the others, members whose sum with the slack can't reach the k-th best sum are dropped, and the rest get their cosines.
        """
        if not len(row) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        most = weight * self.top[at]
        order = np.lexsort((most, row))
        upto = np.cumsum(most[order])
        small = np.zeros(len(row), bool)
        small[order] = upto - np.r_[0, upto][np.searchsorted(row, row[order])] < min(SLACK, floor)
        slack = np.bincount(row[small], most[small], n) + 1e-9
        main = ~small
        entry, width = _spans(self.post_start[at[main]], self.post_start[at[main] + 1])
        w = np.repeat(weight[main], width)
        cell = np.repeat(row[main], width) * self.n_blocks + self.post_block[entry]
        bound = np.bincount(cell, w * self.post_max[entry], n * self.n_blocks)
        alive = (bound > 0) & (bound + np.repeat(slack, self.n_blocks) >= floor)
        number = np.cumsum(alive) - 1
        keep = alive[cell]
        cell, entry, w = cell[keep], entry[keep], w[keep]
        where, width = _spans(self.post_end[entry], self.post_end[entry + 1])
        part = np.bincount(np.repeat(number[cell], width) * BLOCK + self.member[where], np.repeat(w, width) * self.member_weight[where], int(number[-1] + 1) * BLOCK)
        query, block = np.divmod(np.flatnonzero(alive), self.n_blocks)
        query, other = np.repeat(query, BLOCK), (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        keep = (part + slack[query] >= floor) & (other < self.n)
        query, other, part = query[keep], other[keep], part[keep]
        order = np.lexsort((-part, query))
        start = np.searchsorted(query, np.arange(n + 1))
        least, full = np.full(n, floor), np.diff(start) >= k
        least[full] = np.maximum(floor, part[order[start[:-1][full] + k - 1]])
        keep = part + slack[query] >= least[query] - 1e-9
        query, other = query[keep], other[keep]
        used, local = np.unique(at, return_inverse=True)
        self.column[used] = np.arange(len(used))
        dense = np.zeros((n, len(used) + 1))  # the last column is for terms no query has
        dense[row, local] = weight
        where, width = _spans(self.starts[other], self.starts[other + 1])
        each = dense[np.repeat(query, width), self.column[self.at[where]]] * self.weight[where]
        cos = np.add.reduceat(each, np.cumsum(width) - width) if len(other) else np.zeros(0)
        self.column[used] = -1
        keep = cos >= floor
        query, other, cos = query[keep], other[keep], cos[keep]
        order = np.lexsort((other, -cos, query))
        query, other, cos = query[order], other[order], cos[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[keep], other[keep], cos[keep]


class Examples:
    """The distinct passages of the rated documents, in order, with the documents that hold each."""

    def __init__(self, rows: list[tuple[str, int]], ratings: dict[int, float]):
        rows = sorted(rows)
        self.texts = list(dict.fromkeys(t for t, _ in rows))
        number = {t: i for i, t in enumerate(self.texts)}
        self.passage = np.array([number[t] for t, _ in rows], np.int64)
        self.docs, self.doc = np.unique(np.array([d for _, d in rows], np.int64), return_inverse=True)
        self.rating = np.array([ratings[d] for d in self.docs.tolist()])
        self.size = np.bincount(self.passage, minlength=len(self.texts)).astype(float)

    def fit(self, vocabulary: list[str], df: np.ndarray, n: int) -> None:
        self.space = Space(vocabulary, df, n)
        self.row, self.at, self.weight, _ = self.space.vectors(self.texts)
        length = np.sqrt(np.bincount(self.row, self.weight**2, len(self.texts)))
        self.weight = self.weight / np.where(length > 0, length, 1)[self.row]
        self.index = Index(self.row, self.at, self.weight, len(self.texts), len(vocabulary))

    def only(self, which: np.ndarray) -> Index:
        """An index of the chosen examples alone."""
        keep = which[self.row]
        return Index((np.cumsum(which) - 1)[self.row[keep]], self.at[keep], self.weight[keep], int(which.sum()), len(self.space.at))

    def near(self, numbers: np.ndarray, screen: Index | None = None) -> pd.DataFrame:
        """q, j, cos: neighbours of the examples ``numbers``, themselves included; with ``screen`` only of those with a neighbour in it."""
        out = [pd.DataFrame({"q": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "cos": np.zeros(0)})]
        for lo in range(0, len(numbers), QUERIES):
            some = numbers[lo : lo + QUERIES]
            for index, k in ((screen, 1), (self.index, NEIGHBOURS)):
                if index is not None:
                    where, width = _spans(np.searchsorted(self.row, some), np.searchsorted(self.row, some + 1))
                    q, j, cos = index.nearest(np.repeat(np.arange(len(some)), width), self.at[where], self.weight[where], len(some), k)
                    if index is screen:
                        some = some[np.unique(q)]
            out.append(pd.DataFrame({"q": some[q], "j": j, "cos": cos}))
        return pd.concat(out, ignore_index=True)

    def share(self, near: pd.DataFrame, error: float, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(votes of every example, vote of every document without its own passages).

        Each round a passage's chance of being abusive comes from its neighbours in other documents, a document's from
        its passages' and its rating, and the rating goes to the passages in proportion. Passages without ``near`` take no share.
        """
        near = near.sort_values(["q", "cos", "j"], ascending=[True, False, True])
        q, j, cos = near["q"].to_numpy(), near["j"].to_numpy(), near["cos"].to_numpy()
        n, n_docs = len(self.texts), len(self.docs)
        key = self.passage * n_docs + self.doc
        order = np.argsort(key)
        passage, doc, key = self.passage[order], self.doc[order], key[order]
        where, width = _spans(np.searchsorted(q, passage), np.searchsorted(q, passage + 1))
        pair, j, cos = np.repeat(np.arange(len(key)), width), j[where], cos[where]
        at = np.minimum(np.searchsorted(key, j * n_docs + doc[pair]), len(key) - 1)
        own = key[at] == j * n_docs + doc[pair]
        size = self.size[j] - own
        weight = np.where(size > 0, cos**3 * np.sqrt(size), 0)
        total = np.bincount(pair, weight, len(key))
        known = np.bincount(pair, minlength=len(key)) > 0
        per_doc = len(key) / n_docs
        prior = max(float(self.rating.mean()), 1e-3) / per_doc
        says = error + (1 - 2 * error) * self.rating
        share = np.where(known, self.rating[doc], 0.0)
        vote = np.zeros(len(key))
        for _ in range(rounds):
            votes = np.bincount(passage, share, n)
            mean = (votes[j] - np.where(own, share[at], 0)) / np.maximum(size, 1)
            abusive = np.bincount(pair, weight * mean, len(key))
            vote = abusive / (total + DRAW)
            chance = np.where(known, np.clip((abusive + DRAW * prior) / (total + DRAW), 1e-6, 1 - 1e-6), 0)
            some = np.maximum(1 - np.exp(np.bincount(doc, np.log1p(-chance), n_docs)), 1e-12)
            true = some * says / (some * says + (1 - some) * (1 - says))
            share = chance / some[doc] * true[doc]
        share = np.where(share < LEAST_SHARE, 0, share)
        alone = np.zeros(n_docs)
        np.maximum.at(alone, doc, vote)
        return np.bincount(passage, share, n), alone


def calibration(votes: np.ndarray, ratings: np.ndarray, start: tuple[float, float] = (10.0, -4.0)) -> tuple[float, float]:
    """Slope and offset of the logistic curve from votes to ratings by Newton steps, held near ``start`` where ratings are few."""
    x = np.stack([votes, np.ones(len(votes))], axis=1)
    origin = np.array(start)
    beta = origin.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - ratings) + (beta - origin)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most QUERIES rows."""
    for b in it:
        for lo in range(0, b.num_rows, QUERIES):
            yield b.slice(lo, QUERIES)


def document_ratings(labels: DataFrame) -> DataFrame:
    """doc_id, rating, n: the mean and number of a document's distinct ratings; null ratings are none."""
    rows = labels.filter("doc_id is not null and abusive is not null").select("doc_id", "rater", "abusive", "labelled_at").distinct()
    return rows.groupBy("doc_id").agg(F.avg("abusive").alias("rating"), F.count(F.lit(1)).alias("n"))


def rater_error(ratings: np.ndarray, counts: np.ndarray) -> float:
    """The rate at which single ratings err, from how often two of one document differ; at least 0.01."""
    yes, pairs = ratings * counts, counts * (counts - 1) / 2
    differ = float((yes * (counts - yes)).sum() / pairs.sum()) if pairs.sum() else 0.04
    return max(0.01, (1 - math.sqrt(max(0.0, 1 - 2 * differ))) / 2)


def score_documents(docs: DataFrame, labels: DataFrame, *, max_rated: int = MAX_RATED, max_passages: int = MAX_PASSAGES) -> DataFrame:
    """doc_id, score, vote, passage, evidence: every document's calibrated score in 0..1 with its worst passage and that
    passage's nearest rated example.

    A document without an abusive example within reach of any passage has vote 0 and neither passage nor evidence. Texts without a
    word (null, empty, blank) score 0, as does everything when no document is rated abusive. A document rated itself is scored without its own
    passages and has no evidence. Texts are read whole; ids should be unique; null ids are left out. ``max_rated`` and
    ``max_passages`` bound the rated documents that make up the index, those with the smallest hashed ids first.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.filter(F.col("doc_id").isNotNull())
    tasks = max(sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = cutter()
        for pdf in it:
            each = [own(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].repeat([len(p) for p in each]).to_numpy(), "passage": [s for p in each for s in p]})

    key = [F.xxhash64("passage").alias("k1"), F.xxhash64(F.lit(1), "passage").alias("k2")]
    held = materialize(docs.select("doc_id", "text").mapInPandas(cut, "doc_id bigint, passage string").select("doc_id", *key, "passage"))
    distinct = held.groupBy("k1", "k2").agg(F.any_value("passage").alias("passage"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(distinct.repartition(tasks, "k1", "k2"))
    n = distinct.agg(F.sum("n")).first()[0] or 0

    # the rated sample: bounded by max_rated documents and max_passages passages
    rated = document_ratings(labels).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    lengths = held.join(F.broadcast(rated), "doc_id").groupBy("doc_id", "rating", F.col("n").alias("times")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # max_rated rows at most
    rated = materialize(lengths.withColumn("upto", upto).filter(F.col("upto") <= max_passages).select("doc_id", "rating", "times"))
    known = rated.toArrow().to_pandas()
    zero = docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("vote"), F.lit(None).cast("string").alias("passage"), F.lit(None).cast("string").alias("evidence"))
    if known.empty:
        return zero
    rows = held.join(F.broadcast(rated.select("doc_id")), "doc_id", "left_semi").select("passage", "doc_id").toArrow().to_pydict()
    own = Examples(list(zip(rows["passage"], rows["doc_id"])), dict(zip(known["doc_id"], known["rating"])))
    error = rater_error(known["rating"].to_numpy(float), known["times"].to_numpy(float))

    # in how many passages every term occurs
    frequency = materialize(
        distinct.select(F.explode(F.expr(_TERMS)).alias("term"), "n").groupBy(F.xxhash64("term").alias("h")).agg(F.sum("n").alias("df"))
    )
    vocabulary = list(dict.fromkeys(t for s in own.texts for t in terms(s)))
    words = spark.createDataFrame(pa.table({"term": vocabulary})).withColumn("h", F.xxhash64("term"))
    found = frequency.join(F.broadcast(words), "h").select("term", "df").toArrow().to_pandas().set_index("term")["df"]
    own.fit(vocabulary, found.reindex(vocabulary).to_numpy(), n)

    # the examples' neighbours among themselves: first those that may carry a rating, then those near one that does
    sent = sc.broadcast(own)

    def neighbours(numbers: np.ndarray, screen: Index | None) -> pd.DataFrame:
        far = sc.broadcast(screen)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield sent.value.near(np.sort(pdf["i"].to_numpy()), far.value)

        ask = spark.createDataFrame(pa.table({"i": numbers})).repartition(tasks)
        return ask.mapInPandas(run, "q bigint, j bigint, cos double").toArrow().to_pandas()

    accused = np.zeros(len(own.texts), bool)
    accused[own.passage[own.rating[own.doc] > 0]] = True
    if not accused.any():
        return zero
    near = neighbours(np.flatnonzero(accused), None)
    votes, _ = own.share(near, error)
    if (votes > 0).any():
        near = pd.concat([near, neighbours(np.flatnonzero(~accused), own.only(votes > 0))], ignore_index=True)
    votes, alone = own.share(near, error)
    slope, offset = calibration(alone, own.rating)
    final = sc.broadcast((votes / own.size, own.only(votes > 0)))

    # passages that may be near an abusive example, as far as known terms tell
    def screen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, abusive = sent.value.space, final.value[1]
        for b in _slices(it):
            row, at, w, unknown = space.vectors(b.column("passage").to_pylist())
            length = np.bincount(row, w**2, b.num_rows)
            q, _, cos = abusive.nearest(row, at, w / np.sqrt(np.maximum(length, 1e-300))[row], b.num_rows, 1)
            room = pa.array(length[q] * ((cos / FLOOR) ** 2 - 1))
            term = pa.array([[t for t, _ in unknown[i]] for i in q], pa.list_(pa.string()))
            tf = pa.array([[c for _, c in unknown[i]] for i in q], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(q)).columns, room, term, tf], ["k1", "k2", "passage", "room", "unknown", "tf"])

    candidates = distinct.select("k1", "k2", "passage").mapInArrow(
        screen, "k1 bigint, k2 bigint, passage string, room double, unknown array<string>, tf array<int>"
    )
    scored = candidates = materialize(candidates)
    each = candidates.select("k1", "k2", F.explode(F.arrays_zip("unknown", "tf")).alias("u")).select("k1", "k2", F.xxhash64("u.unknown").alias("h"), "u.tf")
    weight = (1 + F.log("tf")) * F.log((F.lit(float(n)) + 1) / (F.col("df") + 0.5))
    rest = keyed_join(each, frequency, ["h"], "df", n).groupBy("k1", "k2").agg(F.sum(weight * weight).alias("rest"))
    candidates = candidates.drop("unknown", "tf").join(rest, ["k1", "k2"], "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))
    candidates = candidates.filter(F.col("rest") <= F.col("room") + 1e-9).repartition(tasks, "k2")  # by another key than the join's, or it is dropped

    def vote(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (mean, _) = sent.value, final.value
        for b in _slices(it):
            row, at, w, _ = own.space.vectors(b.column("passage").to_pylist())
            length = np.sqrt(np.bincount(row, w**2, b.num_rows) + b.column("rest").to_numpy())
            q, j, cos = own.index.nearest(row, at, w / length[row], b.num_rows)
            weight = cos**3 * np.sqrt(own.size[j])
            votes = np.bincount(q, weight * mean[j], b.num_rows) / (np.bincount(q, weight, b.num_rows) + DRAW)
            some = np.flatnonzero(votes > 0)
            evidence = pa.array([own.texts[i] for i in j[np.searchsorted(q, some)]], pa.string())
            kept = b.select(["k1", "k2", "passage"]).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(votes[some]), evidence], ["k1", "k2", "passage", "vote", "evidence"])

    voted = candidates.select("k1", "k2", "passage", "rest").mapInArrow(vote, "k1 bigint, k2 bigint, passage string, vote double, evidence string")
    voted = materialize(voted)
    discard(scored, frequency)
    voted = voted.join(distinct.select("k1", "k2", "n"), ["k1", "k2"])
    worst = (
        keyed_join(held.select("doc_id", "k1", "k2"), voted, ["k1", "k2"], "n", n)
        .groupBy("doc_id")
        .agg(F.max(F.struct("vote", "passage", "evidence")).alias("w"))
    )
    loo = spark.createDataFrame(pa.table({"doc_id": own.docs, "own_vote": alone}))
    worded = F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}#]"), F.lit(False))
    every = docs.select("doc_id", worded.alias("worded")).join(worst, "doc_id", "left").join(F.broadcast(loo), "doc_id", "left")
    total = F.coalesce("own_vote", "w.vote", F.lit(0.0))
    return every.select(
        "doc_id",
        F.when(F.col("worded"), 1 / (1 + F.exp(-(F.lit(slope) * total + offset)))).otherwise(0.0).alias("score"),
        total.alias("vote"),
        F.col("w.passage").alias("passage"),
        F.when(F.col("own_vote").isNull(), F.col("w.evidence")).alias("evidence"),
    )
