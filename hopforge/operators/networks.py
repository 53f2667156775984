"""Networks of several layers trained on the sampled blocks of batches.

A batch's blocks are bounded by its size and fan-outs, so each batch is one
task: an executor runs it forward and back in numpy, and Spark adds the
gradients up. The driver holds the weights and takes Adam's steps.

Kinds: ``sage`` (own vector and mean of the in-neighbours), ``gcn`` (sum
normalised by both degrees in the block, 1 at least) and ``gat`` (softmax
attention in heads, joined in hidden layers and averaged in the last). The
activation between layers is relu, or elu for gat. Layers have no bias, as
those of ``layers``, which score with the same weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopforge.operators.training import Adam

#: Slope of the attention scores below zero.
SLOPE = 0.2

#: Entries of a gradient that are added up together.
SLICE = 4096


@dataclass(frozen=True)
class Network:
    """kind, its weights by layer, and the shares of entries and attentions dropped in training."""

    kind: str
    weights: list[list[np.ndarray]]
    drop: float = 0.0
    drop_attention: float = 0.0

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for layer in self.weights for w in layer])

    def like(self, flat: np.ndarray) -> Network:
        """The same network with other weights."""
        out, at = [], 0
        for layer in self.weights:
            out.append([flat[(at := at + w.size) - w.size : at].reshape(w.shape) for w in layer])
        return Network(self.kind, out, self.drop, self.drop_attention)


def network(kind: str, sizes: Sequence[int], heads: Sequence[int] | None = None, drop: float = 0.0, drop_attention: float = 0.0, seed: int = 0) -> Network:
    """Random weights for layers of these sizes: inputs, hidden ones, classes. A gat layer has ``heads`` of its size each."""
    draw = np.random.default_rng(seed)
    made = lambda *shape: draw.standard_normal(shape) / np.sqrt(shape[-1])
    weights, width = [], sizes[0]
    for i, size in enumerate(sizes[1:]):
        if kind == "sage":
            weights.append([made(size, width), made(size, width)])
        elif kind == "gcn":
            weights.append([made(size, width)])
        elif kind == "gat":
            n = heads[i] if heads else 1
            weights.append([made(n, size, width), made(n, size), made(n, size)])
            size = size * n
        else:
            raise ValueError(f"unknown kind {kind}")
        width = size
    return Network(kind, weights, drop, drop_attention)


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values added up by at, which is from 0 to n - 1."""
    out = np.zeros((n, *values.shape[1:]))
    if len(at):
        order = np.argsort(at, kind="stable")
        keys = at[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out[keys[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sage(w, x, src, dst, n):
    share = 1.0 / np.maximum(1, np.bincount(dst, minlength=n))[:, None]
    mean = _sums(dst, x[src], n) * share

    def back(g):
        gx = _sums(src, (g @ w[1] * share)[dst], len(x))
        gx[:n] += g @ w[0]
        return [g.T @ x[:n], g.T @ mean], gx

    return x[:n] @ w[0].T + mean @ w[1].T, back


def _gcn(w, x, src, dst, n):
    out = 1 / np.sqrt(np.maximum(1, np.bincount(src, minlength=len(x))))[:, None]
    into = 1 / np.sqrt(np.maximum(1, np.bincount(dst, minlength=n)))[:, None]
    total = _sums(dst, (x * out)[src], n) * into

    def back(g):
        return [g.T @ total], _sums(src, (g @ w[0] * into)[dst], len(x)) * out

    return total @ w[0].T, back


def _gat(w, x, src, dst, n, last, keep):
    """keep: attention mask (edge, head), scaled, or None."""
    weight, a_src, a_dst = w
    z = np.einsum("hoi,vi->vho", weight, x)
    raw = (z * a_src).sum(2)[src] + (z * a_dst).sum(2)[dst]
    e = np.where(raw > 0, raw, SLOPE * raw)
    top = np.full((n, e.shape[1]), -np.inf)
    np.maximum.at(top, dst, e)
    e = np.exp(e - top[dst])
    alpha = e / _sums(dst, e, n)[dst]
    used = alpha if keep is None else alpha * keep
    y = _sums(dst, z[src] * used[:, :, None], n)
    heads = y.shape[1]

    def back(g):
        g = np.repeat(g[:, None, :] / heads, heads, axis=1) if last else g.reshape(y.shape)
        g_used = (g[dst] * z[src]).sum(2)
        g_alpha = g_used if keep is None else g_used * keep
        g_e = alpha * (g_alpha - _sums(dst, alpha * g_alpha, n)[dst])
        g_raw = np.where(raw > 0, g_e, SLOPE * g_e)
        at_src, at_dst = _sums(src, g_raw, len(x)), _sums(dst, g_raw, len(x))
        gz = _sums(src, g[dst] * used[:, :, None], len(x)) + at_src[:, :, None] * a_src + at_dst[:, :, None] * a_dst
        grads = [np.einsum("vho,vi->hoi", gz, x), np.einsum("vh,vho->ho", at_src, z), np.einsum("vh,vho->ho", at_dst, z)]
        return grads, np.einsum("vho,hoi->vi", gz, weight)

    return y.mean(1) if last else y.reshape(n, -1), back


def block_sizes(src: np.ndarray, hop: np.ndarray, n_seeds: int, depth: int) -> list[int]:
    """Nodes first met by hop h, for h from 0 to depth; local ids are in the order of first occurrence."""
    sizes = [n_seeds]
    for h in range(1, depth + 1):
        here = src[hop == h]
        sizes.append(max(sizes[-1], int(here.max()) + 1 if len(here) else 0))
    return sizes


def scores(net: Network, x: np.ndarray, src: np.ndarray, dst: np.ndarray, hop: np.ndarray, n_seeds: int, draw: np.random.Generator | None = None):
    """(scores of the seeds, a function from their gradient to the weights').

    Layer i of L sees the edges of hops 1 to L - i. With ``draw``, entries
    and attentions are dropped as in training: before each layer but the
    first, for gat before the first too.
    """
    depth = len(net.weights)
    sizes, backs, x = block_sizes(src, hop, n_seeds, depth), [], x[:].astype(float)
    for i, w in enumerate(net.weights):
        n, last = sizes[depth - i - 1], i == depth - 1
        seen = hop <= depth - i
        s, d, mask, keep = src[seen], dst[seen], None, None
        if draw is not None and net.drop and (i or net.kind == "gat"):
            mask = (draw.random(x.shape) >= net.drop) / (1 - net.drop)
            x = x * mask
        if net.kind == "gat":
            if draw is not None and net.drop_attention:
                keep = (draw.random((len(s), len(w[1]))) >= net.drop_attention) / (1 - net.drop_attention)
            y, back = _gat(w, x, s, d, n, last, keep)
        else:
            y, back = (_sage if net.kind == "sage" else _gcn)(w, x, s, d, n)
        slope = None
        if not last:
            slope = np.where(y > 0, 1.0, np.exp(np.minimum(y, 0)) if net.kind == "gat" else 0.0)
            y = np.where(y > 0, y, np.exp(np.minimum(y, 0)) - 1 if net.kind == "gat" else 0.0)
        backs.append((back, mask, slope))
        x = y

    def gradient(g):
        found = []
        for back, mask, slope in reversed(backs):
            grads, g = back(g if slope is None else g * slope)
            g = g if mask is None else g * mask
            found.append(grads)
        return found[::-1]

    return x, gradient


def loss_and_gradient(net: Network, x, labels, src, dst, hop, draw=None) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of the seeds, which are the first len(labels) nodes, and the flat gradient."""
    z, gradient = scores(net, x, src, dst, hop, len(labels), draw)
    z = z - z.max(1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(1, keepdims=True))
    at = np.arange(len(labels))
    g = np.exp(logp)
    g[at, labels] -= 1
    return -float(logp[at, labels].sum()), np.concatenate([p.ravel() for layer in gradient(g) for p in layer])


def batch_inputs(batch_rows: DataFrame, sampled: DataFrame, mapping: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch, hop, src, dst) with local ids, and (batch, lid, x, label), label null but for seeds. features is (node, x, label)."""
    of = lambda end: mapping.select("batch", F.col("node").alias(end), F.col("lid").alias(f"{end}_lid"))
    edges = sampled.select("batch", "hop", "src", "dst").join(of("src"), ["batch", "src"]).join(of("dst"), ["batch", "dst"])
    marked = mapping.join(batch_rows.select("batch", "node", F.lit(True).alias("seed")), ["batch", "node"], "left")
    nodes = marked.join(features, "node").select("batch", "lid", "x", F.when(F.col("seed"), F.col("label")).cast("long").alias("label"))
    return edges.select("batch", F.col("hop").cast("long").alias("hop"), F.col("src_lid").alias("src"), F.col("dst_lid").alias("dst")), nodes


def batch_gradients(net: Network, edges: DataFrame, nodes: DataFrame, seed: int | None = None) -> DataFrame:
    """(batch, n, loss, g): a row a batch. Every sampled node needs its features; ``seed`` turns dropping on."""
    width = net.weights[0][0].shape[-1]

    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        batch = key[0].as_py()
        right = right.sort_by("lid")
        x = right.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        labels = right.column("label").drop_null().to_numpy()
        src, dst, hop = (left.column(c).to_numpy() for c in ("src", "dst", "hop"))
        draw = None if seed is None else np.random.default_rng([seed, batch])
        loss, g = loss_and_gradient(net, x, labels, src, dst, hop, draw)
        return pa.table({"batch": [batch], "n": [len(labels)], "loss": [loss], "g": [g]}, schema=pa.schema([("batch", pa.int64()), ("n", pa.int64()), ("loss", pa.float64()), ("g", pa.list_(pa.float64()))]))

    # Both sides may come from one table: a name of its own keeps the grouping columns apart.
    edges = edges.select(F.col("batch").alias("edge_batch"), "hop", "src", "dst")
    return nodes.groupBy("batch").cogroup(edges.groupBy("edge_batch")).applyInArrow(lambda k, n, e: one(k, e, n), "batch long, n long, loss double, g array<double>")


def added_gradients(rows: DataFrame) -> tuple[int, float, np.ndarray]:
    """Sums of n, loss and g over batches.

    Each task adds its own batches up and yields slices of SLICE entries;
    then a slice's copies, one a task, are added up. The driver gets one row
    a slice, whatever the number of batches.
    """

    def own(batches):
        n, loss, g = 0, 0.0, None
        for batch in batches:
            for one, part, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, loss, flat = n + one, loss + part, flat.values.to_numpy()
                g = flat.copy() if g is None else g + flat
        if g is not None:
            pieces = [g[at : at + SLICE] for at in range(0, len(g), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array([n] * len(pieces), pa.int64()), pa.array([loss] * len(pieces)), pa.array(pieces, pa.list_(pa.float64()))], names=["at", "n", "loss", "g"])

    def add(key, table):
        copies = table.column("g").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        n, loss = sum(table.column("n").to_pylist()), sum(table.column("loss").to_pylist())
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "loss": pa.array([loss]), "g": pa.array([copies.sum(0)], pa.list_(pa.float64()))})

    shape = "at long, n long, loss double, g array<double>"
    found = rows.select("n", "loss", "g").mapInArrow(own, shape).groupBy("at").applyInArrow(add, shape).toPandas().sort_values("at")
    if not len(found):
        return 0, 0.0, np.zeros(0)
    return int(found["n"].iloc[0]), float(found["loss"].iloc[0]), np.concatenate(found["g"].to_list())


def step(net: Network, adam: Adam, edges: DataFrame, nodes: DataFrame, seed: int | None = None) -> tuple[Network, float, int]:
    """One step of Adam on the mean loss over all batches given: (network, summed loss, seeds). No batch, no step."""
    n, loss, g = added_gradients(batch_gradients(net, edges, nodes, seed))
    return (net.like(adam.step(net.flat(), g / n)) if n else net), loss, n
