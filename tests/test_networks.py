"""Gradients against finite differences; blocks against the DataFrame layers."""

import numpy as np
import pytest

from hopforge.operators import layers, networks, sampler


def _blocks(seed=0):
    """Three seeds, two hops, a seed without in-edges, a double edge."""
    draw = np.random.default_rng(seed)
    src = np.array([3, 4, 4, 0, 5, 6, 3, 7])
    dst = np.array([0, 0, 1, 1, 3, 4, 4, 0])
    hop = np.array([1, 1, 1, 1, 2, 2, 2, 2])
    src, dst, hop = np.r_[src, 3], np.r_[dst, 0], np.r_[hop, 1]
    return draw.standard_normal((8, 5)), np.array([1, 0, 2]), src, dst, hop


@pytest.mark.parametrize("kind,heads,drop", [("sage", None, 0.0), ("gcn", None, 0.0), ("gat", (2, 2), 0.0), ("sage", None, 0.5), ("gat", (3, 1), 0.4)])
def test_gradient_is_the_finite_difference(kind, heads, drop):
    net = networks.network(kind, [5, 4, 3], heads, drop, drop if kind == "gat" else 0.0, seed=3)
    data, w = _blocks(), net.flat()
    loss = lambda flat: networks.loss_and_gradient(net.like(flat), *data, draw=np.random.default_rng(9) if drop else None)[0]
    got = networks.loss_and_gradient(net, *data, draw=np.random.default_rng(9) if drop else None)[1]
    step = 1e-6
    for i in range(len(w)):
        e = np.zeros_like(w)
        e[i] = step
        assert abs((loss(w + e) - loss(w - e)) / (2 * step) - got[i]) < 1e-5


def test_weights_survive_flattening():
    net = networks.network("gat", [5, 4, 3], (2, 1))
    again = net.like(net.flat())
    assert all((a == b).all() for x, y in zip(net.weights, again.weights, strict=True) for a, b in zip(x, y, strict=True))


def test_unknown_kind():
    with pytest.raises(ValueError):
        networks.network("other", [2, 2])


def _sampled(spark):
    draw = np.random.default_rng(5)
    edges = spark.createDataFrame(sorted({(int(a), int(b)) for a, b in draw.integers(0, 30, (150, 2)) if a != b}), "src long, dst long")
    features = spark.createDataFrame([(i, draw.standard_normal(5).tolist(), i % 3) for i in range(30)], "node long, x array<double>, label long")
    rows = sampler.batches(spark.createDataFrame([(i, 0) for i in range(20)], "node long, part long"), 8).cache()
    return rows, sampler.sample(edges, rows, [3, 2]), features


def test_batches_score_like_the_frames(spark):
    """Sum of the losses over batches, against the scores of the DataFrame layers."""
    rows, drawn, features = _sampled(spark)
    net = networks.network("sage", [5, 4, 3], seed=1)
    inputs = networks.batch_inputs(rows, drawn, sampler.remap(rows, drawn), features)
    got = networks.batch_gradients(net, *inputs).toPandas()
    frames = layers.sampled_scores(rows, drawn, features.select("node", "x"), [(net.weights[0][0].tolist(), net.weights[0][1].tolist(), "relu"), (net.weights[1][0].tolist(), net.weights[1][1].tolist(), "none")])
    want = layers.mean_loss(frames.select("node", "x"), features.select("node", "label")).first()
    assert got["n"].sum() == want["n"] == 20
    assert abs(got["loss"].sum() / 20 - want["loss"]) < 1e-5


def test_steps_lower_the_loss(spark):
    rows, drawn, features = _sampled(spark)
    edges, nodes = (t.cache() for t in networks.batch_inputs(rows, drawn, sampler.remap(rows, drawn), features))
    for kind, heads in (("gcn", None), ("gat", (2, 1))):
        net, adam, losses = networks.network(kind, [5, 4, 3], heads), networks.Adam(0.05), []
        for _ in range(4):
            net, loss, n = networks.step(net, adam, edges, nodes)
            losses.append(loss / n)
        assert losses[-1] < losses[0]


def test_gradients_are_added_up_by_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 2, 0.5, [float(i), 1.0, -float(i)]) for i in range(9)], "batch long, n long, loss double, g array<double>").repartition(4)
    for size in (2, 4096):
        monkeypatch.setattr(networks, "SLICE", size)
        n, loss, g = networks.added_gradients(rows)
        assert (n, loss, g.tolist()) == (18, 4.5, [36.0, 9.0, -36.0])
    n, loss, g = networks.added_gradients(rows.where("batch < 0"))
    assert (n, loss, len(g)) == (0, 0.0, 0)
