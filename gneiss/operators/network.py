"""A tabular network: numbers and embedded categories through hidden layers, its losses, training and inference.

Training takes a bounded sample of labelled rows (``max_train``, ``max_val``, drawn by hash) in one task; inference maps over all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.split import order_key

EPS = 1e-5


@dataclass(frozen=True)
class Settings:
    """``loss``: cross_entropy or focal; ``class_weight``: one per class or None. Labels equal to ``ignore`` count nowhere."""

    hidden: tuple[int, ...] = (128, 64, 32, 16)
    dropout: float = 0.1
    max_emb_dim: int = 384
    loss: str = "cross_entropy"
    gamma: float = 2.0
    label_smoothing: float = 0.0
    class_weight: tuple[float, ...] | None = None
    ignore: int = -1
    learning_rate: float = 1e-3
    weight_decay: float = 0.0
    epochs: int = 50
    batch: int = 256
    max_grad_norm: float = 1.0
    patience: int = 5
    min_delta: float = 1e-4
    seed: int = 42

    def __post_init__(self):
        if self.loss not in ("cross_entropy", "focal"):
            raise ValueError(f"unknown loss {self.loss}")
        if self.gamma < 0 or not 0 <= self.label_smoothing < 1:
            raise ValueError("gamma must be at least 0 and label_smoothing in 0..1")


def loss_and_slope(logits: np.ndarray, y: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """Mean loss over the rows whose label counts, and its slope by the logits.

    Cross-entropy against smoothed labels, each class's term times its weight; the focal loss scales a row's cross-entropy
    by (1 - p)^gamma of its label's probability and by its label's weight.
    """
    n, k = logits.shape
    shifted = logits - logits.max(axis=1, keepdims=True)
    log_p = shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))
    p, valid = np.exp(log_p), y != s.ignore
    label, rows = np.where(valid, y, 0), np.arange(n)
    target = np.full((n, k), s.label_smoothing / k)
    target[rows, label] += 1 - s.label_smoothing
    weight = np.ones(k) if s.class_weight is None else np.asarray(s.class_weight, float)
    if s.loss == "cross_entropy":
        part = target * weight
        each, slope = -(part * log_p).sum(axis=1), part.sum(axis=1, keepdims=True) * p - part
    else:
        entropy, sure = -(target * log_p).sum(axis=1), p[rows, label]
        away = 1 - sure
        scale = away**s.gamma
        own = np.zeros((n, k))
        own[rows, label] = 1
        bend = s.gamma * np.maximum(away, 1e-12) ** (s.gamma - 1) * sure * entropy
        each, slope = scale * entropy, scale[:, None] * (p - target) - bend[:, None] * (own - p)
        each, slope = weight[label] * each, weight[label][:, None] * slope
    count = max(int(valid.sum()), 1)
    return float(each[valid].sum() / count), np.where(valid[:, None], slope, 0) / count


class Network:
    """Weights by name; every hidden layer is linear, normalised over the batch, rectified and dropped out."""

    def __init__(self, n_num: int, cards: list[int], n_classes: int, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s, self.cards = s, cards
        self.w: dict[str, np.ndarray] = {}
        self.running: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        width = n_num
        for i, card in enumerate(cards):
            # code 0 is for what training has not seen
            dim = min(s.max_emb_dim, int(np.ceil(1.6 * (card + 1) ** 0.56)))
            self.w[f"e{i}"] = rng.standard_normal((card + 1, dim)) * 0.05
            width += dim
        for i, size in enumerate(s.hidden):
            self.w[f"w{i}"], self.w[f"b{i}"] = rng.standard_normal((width, size)) * np.sqrt(2 / width), np.zeros(size)
            self.w[f"g{i}"], self.w[f"h{i}"] = np.ones(size), np.zeros(size)
            self.running[f"{i}"] = np.zeros(size), np.ones(size)
            width = size
        self.w["out"], self.w["bias"] = rng.standard_normal((width, n_classes)) / np.sqrt(width), np.zeros(n_classes)

    def _codes(self, cats: np.ndarray) -> np.ndarray:
        known = (cats >= 0) & (cats < np.array(self.cards, np.int64)) if self.cards else cats >= 0
        return np.where(known, cats + 1, 0)

    def forward(self, num: np.ndarray, cats: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray, list]:
        """Logits, the last hidden layer and what the way back needs; with ``rng`` as in training."""
        codes = self._codes(cats)
        x = np.concatenate([num, *[self.w[f"e{i}"][codes[:, i]] for i in range(len(self.cards))]], axis=1)
        trail = [(codes, num.shape[1])]
        for i in range(len(self.s.hidden)):
            a = x @ self.w[f"w{i}"] + self.w[f"b{i}"]
            if rng is None:
                mean, var = self.running[f"{i}"]
            else:
                mean, var = a.mean(axis=0), a.var(axis=0)
                old = self.running[f"{i}"]
                self.running[f"{i}"] = 0.9 * old[0] + 0.1 * mean, 0.9 * old[1] + 0.1 * var
            scale = 1 / np.sqrt(var + EPS)
            norm = (a - mean) * scale
            out = norm * self.w[f"g{i}"] + self.w[f"h{i}"]
            keep = (out > 0).astype(float)
            if rng is not None and self.s.dropout:
                keep *= (rng.random(out.shape) >= self.s.dropout) / (1 - self.s.dropout)
            trail.append((x, norm, scale, keep))
            x = out * keep
        return x @ self.w["out"] + self.w["bias"], x, trail

    def backward(self, slope: np.ndarray, z: np.ndarray, trail: list) -> dict[str, np.ndarray]:
        grad = {"out": z.T @ slope, "bias": slope.sum(axis=0)}
        d = slope @ self.w["out"].T
        for i in range(len(self.s.hidden) - 1, -1, -1):
            x, norm, scale, keep = trail[i + 1]
            d = d * keep
            grad[f"g{i}"], grad[f"h{i}"] = (d * norm).sum(axis=0), d.sum(axis=0)
            d = d * self.w[f"g{i}"]
            d = scale * (d - d.mean(axis=0) - norm * (d * norm).mean(axis=0))
            grad[f"w{i}"], grad[f"b{i}"] = x.T @ d, d.sum(axis=0)
            d = d @ self.w[f"w{i}"].T
        codes, at = trail[0]
        for i in range(len(self.cards)):
            width = self.w[f"e{i}"].shape[1]
            grad[f"e{i}"] = np.zeros_like(self.w[f"e{i}"])
            np.add.at(grad[f"e{i}"], codes[:, i], d[:, at : at + width])
            at += width
        return grad

    def predict(self, num: np.ndarray, cats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities and the last hidden layer."""
        logits, z, _ = self.forward(num, cats)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), z


def train(net: Network, train_rows: tuple[np.ndarray, ...], val_rows: tuple[np.ndarray, ...]) -> list[tuple[float, float]]:
    """Train and validation loss of every epoch; the weights of the best epoch are kept.

    Adam steps on shuffled batches with the gradient's norm held; it stops once the validation loss hasn't fallen by ``min_delta`` for ``patience`` epochs.
    """
    s, rng = net.s, np.random.default_rng(net.s.seed)
    num, cats, y = train_rows
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    history, best, waited, step = [], None, 0, 0
    for _ in range(s.epochs):
        total, order = 0.0, rng.permutation(len(y))
        for lo in range(0, len(y), s.batch):
            some = order[lo : lo + s.batch]
            if len(some) < 2:
                continue
            logits, z, trail = net.forward(num[some], cats[some], rng)
            value, slope = loss_and_slope(logits, y[some], s)
            grad = net.backward(slope, z, trail)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            held, step = min(1.0, s.max_grad_norm / max(norm, 1e-12)), step + 1
            for k, g in grad.items():
                g = g * held + s.weight_decay * net.w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.w[k] = net.w[k] - s.learning_rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            total += value * len(some)
        loss = loss_and_slope(net.forward(val_rows[0], val_rows[1])[0], val_rows[2], s)[0]
        history.append((total / max(len(y), 1), loss))
        if best is None or loss < best[0] - s.min_delta:
            best, waited = (loss, dict(net.w), dict(net.running)), 0
        else:
            waited += 1
            if waited >= s.patience:
                break
    if best is not None:
        net.w, net.running = best[1], best[2]
    return history


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = len(pdf)
    cats = np.array(pdf["cats"].tolist(), np.int64).reshape(n, -1) if "cats" in pdf and n else np.zeros((n, 0), np.int64)
    return np.array(pdf["x"].tolist(), float).reshape(n, -1), cats


def fit_network(train_rows: DataFrame, val_rows: DataFrame, settings: Settings = Settings(), *, max_train: int = 200_000, max_val: int = 50_000) -> tuple[Network, list[tuple[float, float]]]:
    """(network, losses of the epochs). Rows: id, label (0..k-1), x and, if any, cats (codes from 0). Numbers should be scaled beforehand."""
    cols = ["id", "label", "x", *[c for c in train_rows.columns if c == "cats"]]
    parts = [df.select(*cols).orderBy(order_key("id", settings.seed), "id").limit(n) for df, n in ((train_rows, max_train), (val_rows, max_val))]
    every = parts[0].withColumn("part", F.lit(0)).unionByName(parts[1].withColumn("part", F.lit(1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "id"])
        sides = []
        for p in (0, 1):
            side = pdf[pdf["part"] == p]
            sides.append((*_arrays(side), side["label"].to_numpy(np.int64)))
        num, cats, y = sides[0]
        net = Network(num.shape[1], [int(c.max()) + 1 for c in cats.T], int(y.max()) + 1, settings)
        history = train(net, *sides)
        return pd.DataFrame({"model": [pickle.dumps((net, history))]})

    row = every.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "model binary").first()
    if row is None:
        raise ValueError("no rows to train on")
    return pickle.loads(row["model"])


def network_predict(net: Network, rows: DataFrame) -> DataFrame:
    """id, y, p, proba, z: prediction, class probabilities and the last hidden layer of every row."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            proba, z = sent.value.predict(*_arrays(pdf))
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["label"], "p": proba.argmax(axis=1), "proba": list(proba), "z": list(z)})

    cols = ["id", "label", "x", *[c for c in rows.columns if c == "cats"]]
    return rows.select(*cols).mapInPandas(batches, "id bigint, y int, p int, proba array<double>, z array<double>")
