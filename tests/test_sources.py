"""Raw files, ranges, registries and layers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopforge.operators import layers, linkpred, training
from hopforge.sources import binary as B


def test_vectors_round_trip(spark, tmp_path):
    edges = np.array([[1, 2], [3, 4], [5, 6]], "<i4")
    edges.tofile(tmp_path / "graph.bin")
    assert sorted(tuple(r) for r in B.read_edges(spark, str(tmp_path / "graph.bin")).collect()) == [(1, 2), (3, 4), (5, 6)]
    feats = np.arange(12, dtype="<f4").reshape(4, 3)
    feats.tofile(tmp_path / "feat.bin")
    found = B.read_features(spark, str(tmp_path / "feat.bin"), 3, 1, 3).orderBy("node").collect()
    assert [(r.node, list(r.feat)) for r in found] == [(1, [3, 4, 5]), (2, [6, 7, 8])]
    rows = spark.createDataFrame([(2, [5.0, 6.0]), (0, [1.0, 2.0]), (1, [3.0, 4.0])], "node long, feat array<float>")
    B.write_vectors(rows, str(tmp_path / "out"), "float32", "node", "feat")
    B.export_file(spark, str(tmp_path / "out"), str(tmp_path / "out.bin"))
    assert np.fromfile(tmp_path / "out.bin", "<f4").tolist() == [1, 2, 3, 4, 5, 6]
    B.export_file(spark, str(tmp_path / "out"), str(tmp_path / "out.bin"), append=True)
    assert len(np.fromfile(tmp_path / "out.bin", "<f4")) == 12


def test_dataset_folder_and_params(spark, tmp_path):
    np.array([[0, 1], [1, 2]], "<i4").tofile(tmp_path / "graph.bin")
    np.zeros((3, 2), "<f4").tofile(tmp_path / "feat.bin")
    np.array([5, 6, 7], "<i8").tofile(tmp_path / "labels.bin")
    np.array([2], "<i8").tofile(tmp_path / "trainIds.bin")
    found = B.read_dataset(spark, str(tmp_path), 2)
    assert {k: df.count() for k, df in found.items()} == {"edges": 2, "features": 3, "labels": 3, "train": 1}
    assert [tuple(r) for r in found["labels"].orderBy("node").collect()] == [(0, 5), (1, 6), (2, 7)]
    weights = {"a": np.arange(6.0).reshape(2, 3), "b": np.ones(4)}
    B.params_table(spark, weights).write.parquet(str(tmp_path / "params"))
    back = B.params_from(spark.read.parquet(str(tmp_path / "params")))
    assert np.array_equal(back["a"], weights["a"]) and back["b"].shape == (1, 4)


def test_split_edges(spark, tmp_path):
    np.array([1, 2, 3], "<i8").tofile(tmp_path / "srcList.bin")
    np.array([4, 5, 6], "<i8").tofile(tmp_path / "dstList.bin")
    found = B.read_split_edges(spark, str(tmp_path / "srcList.bin"), str(tmp_path / "dstList.bin"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 4), (2, 5), (3, 6)]


@pytest.mark.parametrize(("slices", "n"), [(8, 48), (8, 1), (8, 100), (3, 0)])
def test_slice_bounds(slices, n):
    bounds = B.slice_bounds(slices, n)
    assert all(a <= b for a, b in bounds)
    assert [x for a, b in bounds for x in range(a, b)] == list(range(n))


def test_registry_manifest_meta_config(spark, tmp_path):
    (tmp_path / "info.json").write_text(json.dumps({"PD": {"edges": 10, "nodes": 4, "featLen": 3, "classes": 2, "trainNUM": 1}}))
    row = B.read_registry(spark, str(tmp_path / "info.json")).first()
    assert (row.dataset, row.edges, row.nodes, row.valNUM) == ("PD", 10, 4, None)
    manifest = spark.createDataFrame([(0, 5, 7, 1), (1, 6, 8, 0)], "part long, n_nodes long, n_edges long, seq long")
    (tmp_path / "m.json").write_text(B.manifest_json(manifest))
    assert sorted(map(tuple, B.read_manifest(spark, str(tmp_path / "m.json")).collect())) == [(0, 5, 7, 1), (1, 6, 8, 0)]
    B.write_meta(spark.createDataFrame([("nodes", "4")], "key string, value string"), str(tmp_path / "meta"))
    assert tuple(B.read_meta(spark, str(tmp_path / "meta")).first()) == ("nodes", "4")
    assert B.TrainConfig.from_text('{"fanout": [5, 5], "model": "GAT", "cacheNUM": 2}').fanout == (5, 5)
    with pytest.raises(ValueError, match="two"):
        B.TrainConfig.from_text('{"fanout": [5, 5, 5], "model": "GAT"}')


def test_synthetic_and_masks(spark):
    feats, labels, train = B.synthetic_dataset(spark, 250, 3)
    assert (feats.count(), labels.where("label = 1").count(), train.count()) == (250, 250, 2)
    nodes = spark.range(5).select(F.col("id").alias("node"), (F.col("id") % 2 == 0).alias("train_mask"))
    assert sorted(r.node for r in B.mask_to_ids(nodes, "train_mask").collect()) == [0, 2, 4]


@pytest.fixture(scope="module")
def tiny(spark):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((6, 3))
    pairs = [(0, 1), (2, 1), (3, 1), (4, 0), (1, 2), (1, 3)]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>")
    return x, pairs, spark.createDataFrame(pairs, "src long, dst long"), nodes


def matrix(df):
    return np.array([r.x for r in df.orderBy("node").collect()])


def test_layers_against_numpy(tiny):
    x, pairs, edges, nodes = tiny
    ws, wn = (np.array(layers.fixed_weights(2, 3, s)) for s in (0, 5))
    into = {v: [a for a, b in pairs if b == v] for v in range(6)}
    mean = np.array([x[into[v]].mean(0) if into[v] else np.zeros(3) for v in range(6)])
    assert np.allclose(matrix(layers.sage_mean(edges, nodes, ws.tolist(), wn.tolist())), x @ ws.T + mean @ wn.T)
    out = np.array([max(1, sum(a == v for a, _ in pairs)) for v in range(6)])
    deg = np.array([max(1, len(into[v])) for v in range(6)])
    summed = np.array([sum((x[u] / np.sqrt(out[u] * deg[v]) for u in into[v]), np.zeros(3)) for v in range(6)])
    assert np.allclose(matrix(layers.gcn(edges, nodes, ws.tolist())), summed @ ws.T)
    heads = [(layers.fixed_weights(2, 3, h), layers.fixed_weights(1, 2, h + 1)[0], layers.fixed_weights(1, 2, h + 2)[0]) for h in (0, 4)]
    want = []
    for w, a, b in heads:
        z = x @ np.array(w).T
        e = lambda u, v, z=z, a=a, b=b: (lambda s: s if s > 0 else 0.2 * s)(z[u] @ a + z[v] @ b)
        rows = []
        for v in range(6):
            s = np.exp([e(u, v) for u in into[v]])
            rows.append((s[:, None] * z[into[v]]).sum(0) / s.sum() if into[v] else np.zeros(2))
        want.append(np.array(rows))
    assert np.allclose(matrix(layers.gat(edges, nodes, heads)), (want[0] + want[1]) / 2)
    assert np.allclose(matrix(layers.gat(edges, nodes, heads, "concat")), np.hstack(want))


def test_mlp_activations_and_argmax(spark, tiny):
    x, _, _, nodes = tiny
    w1, w2 = np.array(layers.fixed_weights(4, 3)), np.array(layers.fixed_weights(2, 4, 2))
    got = matrix(layers.mlp(nodes, [(w1.tolist(), [0.1] * 4), (w2.tolist(), [0.0] * 2)]))
    assert np.allclose(got, np.maximum(0, x @ w1.T + 0.1) @ w2.T)
    soft = matrix(layers.linear(nodes, w1.tolist(), activation="log_softmax"))
    assert np.allclose(np.exp(soft).sum(1), 1)
    ties = spark.createDataFrame([(0, [1.0, 2.0, 2.0])], "node long, x array<double>")
    assert layers.predictions(ties).first().pred == 1
    params = spark.createDataFrame([(0, 0, 0, 0.5), (0, 0, 1, 0.5)], "layer long, i long, j long, w double")
    assert layers.parameter_count(params).first()[0] == 2


def test_training_learns_a_split(spark):
    rows = spark.createDataFrame([([float(i % 2), 1.0], i % 2) for i in range(40)], "x array<double>, label long")
    w, losses = training.softmax_head(rows, 2, epochs=30, rate=0.1, reset_every=10)
    assert losses[-1] < losses[0] / 2
    empty = spark.createDataFrame([], "x array<double>, label long")
    assert training.softmax_head(empty, 2)[1] == []


def test_only_the_range_is_read(spark, tmp_path, monkeypatch):
    np.arange(3_000, dtype="<f4").tofile(tmp_path / "feat.bin")
    reader = B.RawReader({"path": str(tmp_path / "feat.bin"), "kind": "float32", "width": "3", "begin": "100", "end": "107"})
    monkeypatch.setattr(B, "TASK_BYTES", 36)
    parts = reader.partitions()
    assert [p.value for p in parts] == [(100, 103), (103, 106), (106, 107)]
    assert [b.column(0).to_pylist() for b in reader.read(parts[0])] == [[100, 101, 102]]
    got = B.read_features(spark, f"file://{tmp_path}/feat.bin", 3, 100, 107).orderBy("node").collect()
    assert [(r.node, list(r.feat)) for r in got] == [(i, [3.0 * i, 3.0 * i + 1, 3.0 * i + 2]) for i in range(100, 107)]
    assert B.read_vectors(spark, str(tmp_path / "feat.bin"), "float32").count() == 3000
    with pytest.raises(Exception, match="whole rows"):
        B.read_vectors(spark, str(tmp_path / "feat.bin"), "float32", 7).count()


def test_dataset_to_column_files(spark, tmp_path):
    edges = spark.createDataFrame([(2, 0), (0, 1), (1, 2), (0, 2)], "src long, dst long")
    features = spark.createDataFrame([(i, [i + 0.5, -i + 0.0]) for i in range(3)], "node long, feat array<float>")
    labels = spark.createDataFrame([(2, 7), (0, 5), (1, 6)], "node long, label long")
    splits = spark.createDataFrame([(0, "train"), (1, "test"), (2, "train")], "node long, split string")
    B.convert_dataset(edges, features, labels, splits, str(tmp_path / "d"))
    held = lambda name, code: np.frombuffer(b"".join(B.vector_bytes(spark, str(tmp_path / "d" / name))), code).tolist()
    assert list(zip(held("srcList", "<i8"), held("dstList", "<i8"), strict=True)) == [(0, 1), (0, 2), (1, 2), (2, 0)]
    assert held("feat", "<f4") == [0.5, 0.0, 1.5, -1.0, 2.5, -2.0] and held("labels", "<i8") == [5, 6, 7]
    assert held("trainIds", "<i8") == [0, 2] and held("valIDs", "<i8") == [] and held("testIDs", "<i8") == [1]


def test_splits_are_written_by_split(spark, tmp_path):
    drawn = spark.createDataFrame([("test", 1, 2, 2, 9), ("test", 1, 2, 1, 8), ("train", 3, 4, 1, 7)], "split string, src long, dst long, k long, neg_dst long")
    linkpred.write_splits(linkpred.split_rows(drawn), str(tmp_path / "s"))
    assert [tuple(r) for r in linkpred.read_splits(spark, str(tmp_path / "s"), "test").select("source_node", "target_node", "target_node_neg").collect()] == [(1, 2, [8, 9])]
    assert linkpred.read_splits(spark, str(tmp_path / "s")).count() == 2
