"""Training without a deep-learning library.

Gradients are sums over rows, made on executors and added up by Spark; the
driver holds the weights and takes the steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopforge.functions import vectors as V
from hopforge.plans.lineage import cut


@dataclass
class Adam:
    """Adam's state for one array of weights."""

    rate: float = 1e-3
    decay: float = 0.0
    first: float = 0.9
    second: float = 0.999
    steps: int = 0
    m: np.ndarray | float = field(default=0.0)
    v: np.ndarray | float = field(default=0.0)

    def step(self, w: np.ndarray, grad: np.ndarray) -> np.ndarray:
        grad = grad + self.decay * w
        self.steps += 1
        self.m = self.first * self.m + (1 - self.first) * grad
        self.v = self.second * self.v + (1 - self.second) * grad * grad
        return w - self.rate * (self.m / (1 - self.first**self.steps)) / (np.sqrt(self.v / (1 - self.second**self.steps)) + 1e-8)


def smoothed(edges: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """(node, x): each hop replaces x by the mean of a node's own x and its in-neighbours'."""
    width = len(nodes.select("x").first()[0])
    for _ in range(hops):
        sent = edges.join(nodes.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "x").unionByName(nodes)
        nodes = cut(sent.groupBy("node").agg(V.mean_of("x", width).alias("x")))
    return nodes


def _added(parts: DataFrame) -> tuple[int, float, np.ndarray]:
    """Sums of n, loss and the vector g. A row per entry: the size of the weights, whatever the number of rows."""
    summed = parts.select("n", "loss", F.posexplode("g").alias("at", "g")).groupBy("at").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum("loss").alias("loss")).toPandas().sort_values("at")
    return int(summed["n"].iloc[0]), float(summed["loss"].iloc[0]), summed["g"].to_numpy()


def softmax_head(rows: DataFrame, classes: int, epochs: int = 10, rate: float = 0.05, decay: float = 5e-4, reset_every: int | None = None) -> tuple[np.ndarray, list[float]]:
    """(weights, loss per epoch) of a linear softmax classifier on (x, label) rows.

    One pass a full-batch epoch. ``reset_every`` starts Adam anew after so
    many epochs.
    """
    held = cut(rows.select("x", F.col("label").cast("long").alias("label")))
    first = held.select("x").first()
    if first is None:
        return np.zeros((classes, 1)), []
    width = len(first[0])
    w, adam, losses = np.zeros((classes, width + 1)), Adam(rate, decay), []

    for epoch in range(epochs):
        if reset_every and epoch % reset_every == 0:
            adam = Adam(rate, decay)

        def gradient(batches, w=w):
            total, loss, n = np.zeros_like(w), 0.0, 0
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                x = np.hstack([x, np.ones((len(x), 1))])
                y = batch.column(1).to_numpy(zero_copy_only=False)
                z = x @ w.T
                z -= z.max(1, keepdims=True)
                logp = z - np.log(np.exp(z).sum(1, keepdims=True))
                loss -= float(logp[np.arange(len(y)), y].sum())
                p = np.exp(logp)
                p[np.arange(len(y)), y] -= 1
                total += p.T @ x
                n += len(y)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([total.ravel().tolist()])], names=["n", "loss", "g"])

        parts = held.mapInArrow(gradient, "n long, loss double, g array<double>")
        n, loss, g = _added(parts)
        w = adam.step(w, g.reshape(w.shape) / n)
        losses.append(loss / n)
    return w, losses


def sage_epoch(rows: DataFrame, weights: list[np.ndarray]) -> tuple[list[np.ndarray], float, int]:
    """Gradient, loss and count of a one-hidden-layer network on (x, m, label) rows.

    x is a node's own vector and m the mean of its sampled neighbours: the
    hidden layer is relu(W_s x + W_n m), the scores are V hidden.
    """
    w_self, w_neigh, v = weights
    width, sizes = w_self.shape[1], [w.size for w in weights]

    def gradient(batches):
        total, loss, n = [np.zeros_like(w) for w in weights], 0.0, 0
        for batch in batches:
            x, m = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for i in (0, 1))
            y = batch.column(2).to_numpy(zero_copy_only=False)
            h = np.maximum(0, x @ w_self.T + m @ w_neigh.T)
            z = h @ v.T
            z -= z.max(1, keepdims=True)
            logp = z - np.log(np.exp(z).sum(1, keepdims=True))
            loss -= float(logp[np.arange(len(y)), y].sum())
            d = np.exp(logp)
            d[np.arange(len(y)), y] -= 1
            dh = (d @ v) * (h > 0)
            for t, g in zip(total, (dh.T @ x, dh.T @ m, d.T @ h), strict=True):
                t += g
            n += len(y)
        flat = np.concatenate([t.ravel() for t in total]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([flat])], names=["n", "loss", "g"])

    parts = rows.select("x", "m", F.col("label").cast("long")).mapInArrow(gradient, "n long, loss double, g array<double>")
    n, loss, g = _added(parts)
    pieces = np.split(g / max(n, 1), np.cumsum(sizes)[:-1])
    return [p.reshape(w.shape) for p, w in zip(pieces, weights, strict=True)], loss / max(n, 1), n


def train_sage(rows: DataFrame, hidden: int, classes: int, epochs: int = 10, rate: float = 0.01) -> tuple[list[np.ndarray], list[float]]:
    """(weights, losses) of the network of sage_epoch, by full-batch Adam."""
    held = cut(rows)
    width = len(held.select("x").first()[0])
    draw = np.random.default_rng(0)
    weights = [draw.standard_normal(s) / np.sqrt(s[1]) for s in ((hidden, width), (hidden, width), (classes, hidden))]
    adams, losses = [Adam(rate) for _ in weights], []
    for _ in range(epochs):
        grads, loss, _ = sage_epoch(held, weights)
        weights = [a.step(w, g) for a, w, g in zip(adams, weights, grads, strict=True)]
        losses.append(loss)
    return weights, losses
