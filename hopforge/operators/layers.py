"""Graph-network layers, layer-wise inference, prediction and accuracy.

A node is (node, x) with x an ARRAY<DOUBLE>. Layers aggregate with one sum or
mean per vector entry, which Spark combines before it shuffles. Weights are
driver values: a matrix is a list of rows, one row per output.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopforge.functions import vectors as V
from hopforge.operators.degrees import degrees
from hopforge.plans.lineage import cut

Matrix = Sequence[Sequence[float]]
ACTIVATIONS = {"none": lambda x: x, "relu": V.relu, "elu": V.elu, "log_softmax": V.log_softmax}


def fixed_weights(rows: int, columns: int, salt: int = 0) -> list[list[float]]:
    """Repeatable weights from -0.5 to 0.5 for examples and tests."""
    return [[((i * 7 + j * 3 + salt) % 11 - 5) / 10.0 for j in range(columns)] for i in range(rows)]


def linear(nodes: DataFrame, weights: Matrix, bias: Sequence[float] | None = None, activation: str = "none") -> DataFrame:
    """(node, x) -> (node, W x + b)."""
    out = V.matvec(V.literal(weights), F.col("x"))
    if bias is not None:
        out = V.add(out, V.literal(bias))
    return nodes.select("node", ACTIVATIONS[activation](out).alias("x"))


def mlp(nodes: DataFrame, layers: Sequence[tuple[Matrix, Sequence[float]]], activation: str = "relu") -> DataFrame:
    """Linear layers with an activation after each but the last."""
    for i, (weights, bias) in enumerate(layers):
        nodes = linear(nodes, weights, bias, activation if i + 1 < len(layers) else "none")
    return nodes


def _messages(edges: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    return edges.join(nodes.withColumnRenamed("node", "src"), "src").select("src", "dst", "x", *more)


def sage_mean(edges: DataFrame, nodes: DataFrame, w_self: Matrix, w_neigh: Matrix, activation: str = "none") -> DataFrame:
    """W_self x + W_neigh (mean of the in-neighbours); nodes without any have a mean of 0."""
    width = len(w_self[0])
    mean = _messages(edges, nodes).groupBy(F.col("dst").alias("node")).agg(V.mean_of("x", width).alias("m"))
    both = nodes.join(mean, "node", "left").withColumn("m", F.coalesce("m", V.literal([0.0] * width)))
    out = V.add(V.matvec(V.literal(w_self), F.col("x")), V.matvec(V.literal(w_neigh), F.col("m")))
    return both.select("node", ACTIVATIONS[activation](out).alias("x"))


def gcn(edges: DataFrame, nodes: DataFrame, weights: Matrix, activation: str = "none") -> DataFrame:
    """W (sum over in-neighbours of x / sqrt(outdeg(u) indeg(v))), degrees 1 at least."""
    width = len(weights[0])
    deg = degrees(edges, nodes.select("node"))
    sent = nodes.join(deg, "node").select("node", V.scale(F.col("x"), 1 / F.sqrt(F.greatest("outdeg", F.lit(1)))).alias("x"))
    got = _messages(edges, sent).groupBy(F.col("dst").alias("node")).agg(V.sum_of("x", width).alias("s"))
    joined = deg.join(got, "node", "left")
    total = V.scale(F.coalesce("s", V.literal([0.0] * width)), 1 / F.sqrt(F.greatest("indeg", F.lit(1))))
    return joined.select("node", ACTIVATIONS[activation](V.matvec(V.literal(weights), total)).alias("x"))


def gat(edges: DataFrame, nodes: DataFrame, heads: Sequence[tuple[Matrix, Sequence[float], Sequence[float]]], combine: str = "mean", activation: str = "none") -> DataFrame:
    """Softmax attention over in-edges, one (W, a_src, a_dst) per head; heads are averaged or concatenated.

    The score is leaky_relu(a_src W x_u + a_dst W x_v); each softmax is
    shifted by its largest score. Nodes without in-edges get zeros.
    """
    parts, out = [], None
    for h, (weights, a_src, a_dst) in enumerate(heads):
        width = len(weights)
        z = V.matvec(V.literal(weights), F.col("x"))
        hidden = nodes.select("node", z.alias("x")).select("node", "x", V.dot(F.col("x"), V.literal(a_src)).alias("l"), V.dot(F.col("x"), V.literal(a_dst)).alias("r"))
        met = _messages(edges, hidden.drop("r"), "l").join(hidden.select(F.col("node").alias("dst"), "r"), "dst")
        scored = met.select("dst", "x", V.leaky_relu(F.col("l") + F.col("r")).alias("e"))
        top = scored.groupBy("dst").agg(F.max("e").alias("top"))
        weighed = scored.join(top, "dst").withColumn("w", F.exp(F.col("e") - F.col("top")))
        summed = weighed.groupBy(F.col("dst").alias("node")).agg(F.array(*[F.sum(F.col("x")[i] * F.col("w")) / F.sum("w") for i in range(width)]).alias(f"h{h}"))
        parts.append((f"h{h}", width))
        out = nodes.select("node").join(summed, "node", "left") if out is None else out.join(summed, "node", "left")
    filled = [F.coalesce(name, V.literal([0.0] * width)) for name, width in parts]
    if combine == "concat":
        x = F.concat(*filled)
    else:
        x = filled[0]
        for more in filled[1:]:
            x = V.add(x, more)
        x = V.scale(x, F.lit(1.0 / len(filled)))
    return out.select("node", ACTIVATIONS[activation](x).alias("x"))


def batch_norm(nodes: DataFrame, gamma: Sequence[float], beta: Sequence[float], eps: float = 1e-5) -> DataFrame:
    """Each entry shifted and scaled by its mean and variance over all nodes.

    The statistics are one row of the vector's width, brought to the driver.
    """
    width = len(gamma)
    stats = nodes.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)], *[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(width)]).first()
    if stats[0] is None:
        return nodes
    rate = [g / math.sqrt(stats[f"v{i}"] + eps) for i, g in enumerate(gamma)]
    shift = [b - stats[f"m{i}"] * r for i, (b, r) in enumerate(zip(beta, rate, strict=True))]
    scaled = F.zip_with("x", V.literal(rate), lambda x, r: x * r)
    return nodes.select("node", V.add(scaled, V.literal(shift)).alias("x"))


def residual_sage(edges: DataFrame, nodes: DataFrame, blocks: Sequence[tuple[Matrix, Matrix]], head: Sequence[tuple[Matrix, Sequence[float]]]) -> DataFrame:
    """Mean layers with batch norm, relu and a residual each; all their outputs, joined, go through an MLP."""
    seen = [nodes]
    for w_self, w_neigh in blocks:
        width = len(w_self)
        made = batch_norm(sage_mean(edges, nodes, w_self, w_neigh), [1.0] * width, [0.0] * width)
        nodes = cut(made.withColumnRenamed("x", "y").join(nodes, "node").select("node", V.add(V.relu(F.col("y")), F.col("x")).alias("x")))
        seen.append(nodes)
    joined = seen[0].withColumnRenamed("x", "x0")
    for i, layer in enumerate(seen[1:], 1):
        joined = joined.join(layer.withColumnRenamed("x", f"x{i}"), "node")
    return mlp(joined.select("node", F.concat(*[f"x{i}" for i in range(len(seen))]).alias("x")), head)


def inference(nodes: DataFrame, layers: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each layer over all nodes and all in-neighbours before the next one starts."""
    for layer in layers:
        nodes = cut(layer(nodes))
    return nodes


def sampled_scores(batch_rows: DataFrame, sampled: DataFrame, nodes: DataFrame, layers: Sequence[tuple[Matrix, Matrix, str]]) -> DataFrame:
    """(batch, node, x) of the seeds: mean layers (W_self, W_neigh, activation) over the sampled blocks of their batches.

    The first of L layers sees the edges of all L hops, the last those of the
    first hop alone. An edge drawn twice counts twice.
    """
    now = batch_rows.select("batch", "node").unionByName(sampled.select("batch", F.col("src").alias("node"))).distinct().join(nodes, "node")
    for i, (w_self, w_neigh, activation) in enumerate(layers):
        width = len(w_self[0])
        block = sampled.where(F.col("hop") <= len(layers) - i).select("batch", "src", "dst")
        sent = block.join(now.withColumnRenamed("node", "src"), ["batch", "src"])
        mean = sent.groupBy("batch", F.col("dst").alias("node")).agg(V.mean_of("x", width).alias("m"))
        both = now.join(mean, ["batch", "node"], "left").withColumn("m", F.coalesce("m", V.literal([0.0] * width)))
        out = V.add(V.matvec(V.literal(w_self), F.col("x")), V.matvec(V.literal(w_neigh), F.col("m")))
        now = cut(both.select("batch", "node", ACTIVATIONS[activation](out).alias("x")))
    return now.join(batch_rows.select("batch", "node"), ["batch", "node"], "left_semi")


def mean_loss(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: n and the mean cross-entropy of the labelled nodes."""
    own = F.element_at(V.log_softmax(F.col("x")), (F.col("label") + 1).cast("int"))
    return scores.join(labels, "node").agg(F.count("*").alias("n"), F.round(-F.avg(own), 6).alias("loss"))


def predictions(nodes: DataFrame) -> DataFrame:
    """(node, pred): the class of the largest score, the lowest of equals."""
    return nodes.select("node", V.argmax(F.col("x")).cast("long").alias("pred"))


def accuracy(predicted: DataFrame, labels: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, n, accuracy)."""
    right: Column = F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0))
    return predicted.join(labels, "node").join(splits, "node").groupBy("split").agg(F.count("*").alias("n"), F.round(right, 6).alias("accuracy"))


def parameter_count(params: DataFrame) -> DataFrame:
    """One row: how many weights a (layer, i, j, w) table holds."""
    return params.agg(F.count("*").alias("n_params"))
