"""The query catalogue over the example graphs; ``oracle`` has the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.operators import budget, cluster, degrees, delta, layers, linkpred, merge, networks, order, propagate, sampler, subgraph, tiers, training
from hopforge.plans import fixtures as fx
from hopforge.plans import jobs
from hopforge.plans.lineage import cut
from hopforge.plans.placement import placed
from hopforge.sources.binary import feature_range, params_table, slice_bounds, synthetic_dataset
from hopforge.sources.binary import slice_ids as slice_ids_
from hopforge.sources.binary import zero_features as zero_features_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Settings of the sampled queries.
BATCH, FANOUTS = 16, (3, 3, 2)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _members(s: SparkSession, d: str, kind: str = "sparse") -> tuple[DataFrame, DataFrame]:
    edges = fx.edges(s, d, kind)
    return edges, propagate.membership(edges, fx.seeds(s, d))


def _interior(members: DataFrame) -> DataFrame:
    return members.where("hop < 3").select("part", "node")


def _kept(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges, members = _members(s, d)
    return members, subgraph.induced_edges(edges, _interior(members), fx.seeds(s, d))


@query
def edges_copurchase(s, d):
    return fx.edges(s, d)


@query
def edges_full(s, d):
    return degrees.in_degree(fx.edges(s, d, "full"))


@query
def degree_in_out(s, d):
    return degrees.degrees(fx.edges(s, d, "mid"), fx.nodes(s, d))


@query
def avg_degree(s, d):
    return degrees.average_degree(fx.edges(s, d, "mid"), fx.nodes(s, d))


@query
def seed_label_propagation(s, d):
    return cluster.seed_labels(fx.edges(s, d, "full"), fx.seeds(s, d))


@query
def seed_label_histogram(s, d):
    return cluster.label_histogram(cluster.seed_labels(fx.edges(s, d, "mid"), fx.seeds(s, d)))


@query
def seed_labels_by_size(s, d):
    return cluster.labels_by_size(cluster.label_histogram(cluster.seed_labels(fx.edges(s, d, "mid"), fx.seeds(s, d))))


@query
def seed_partition_assign(s, d):
    return cluster.assign_parts(cluster.seed_labels(fx.edges(s, d, "mid"), fx.seeds(s, d)), fx.PARTS)


@query
def khop_membership(s, d):
    return _members(s, d)[1].select("part", "node", "hop")


@query
def khop_bitmask(s, d):
    return propagate.bitmask(_members(s, d)[1])


@query
def khop_boundary(s, d):
    return propagate.boundary(_members(s, d)[1])


@query
def value_propagation(s, d):
    return propagate.values(fx.edges(s, d), fx.nodes(s, d), fx.seeds(s, d))


@query
def value_rank_in_part(s, d):
    edges, members = _members(s, d)
    return subgraph.ranked_by_value(members, propagate.values(edges, fx.nodes(s, d), fx.seeds(s, d)))


@query
def value_rank_local(s, d):
    edges, members = _members(s, d)
    ranked = subgraph.ranked_by_value(members, propagate.values(edges, fx.nodes(s, d), fx.seeds(s, d)))
    return subgraph.ranked_local(ranked, subgraph.local_ids(members))


@query
def merge_cost_pairs(s, d):
    edges, members = _members(s, d)
    return merge.pair_costs(members, edges.count() / fx.nodes(s, d).count())


@query
def merge_plan(s, d):
    edges = fx.edges(s, d)
    members = propagate.membership(edges, fx.seeds(s, d, 8))
    return merge.merge_plan(members, edges.count() / fx.nodes(s, d).count())


@query
def merge_plan_whole(s, d):
    """Without a ceiling that binds four parts become one."""
    members = _members(s, d)[1]
    return merge.merge_plan(members, 5.0)


@query
def merge_plan_refused(s, d):
    """With a ceiling of nothing the cheapest and the dearest part are tried and refused at each level."""
    members = _members(s, d)[1]
    return merge.merge_plan(members, 5.0, ceiling=0.0)


@query
def partition_job(s, d):
    """The manifest of the whole job; no ceiling binds, so it ends with one part."""
    return jobs.partition(fx.edges(s, d), fx.nodes(s, d), fx.seeds(s, d).select("node"), fx.PARTS).manifest.select("part", "n_nodes", "n_edges", "seq")


@query
def partition_job_seeds(s, d):
    """Training ids of the job's merged parts."""
    return jobs.partition(fx.edges(s, d), fx.nodes(s, d), fx.seeds(s, d).select("node"), fx.PARTS).seeds.select("part", "node")


@query
def merged_boundary(s, d):
    members = _members(s, d)[1]
    plan = s.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "part long, merged_part long")
    return merge.merged(members, plan)


@query
def induced_edges(s, d):
    return _kept(s, d)[1]


@query
def self_loops(s, d):
    return subgraph.self_loops(fx.seeds(s, d))


@query
def closure_violations(s, d):
    edges, members = _members(s, d)
    found = subgraph.closure_violations(edges, members, _interior(members))
    return found.agg(F.count("*").alias("violations"))


@query
def local_ids(s, d):
    return subgraph.local_ids(_members(s, d)[1])


def _local(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    members, kept = _kept(s, d)
    ids = cut(subgraph.local_ids(members))
    return ids, subgraph.relabelled(kept, ids)


@query
def csc_indptr(s, d):
    ids, local = _local(s, d)
    return subgraph.indptr(local, ids)


@query
def csc_degrees(s, d):
    ids, local = _local(s, d)
    return subgraph.degrees_from_indptr(subgraph.indptr(local, ids))


@query
def csc_indices(s, d):
    return subgraph.indices(_local(s, d)[1])


@query
def csc_adjacency(s, d):
    rows = subgraph.adjacency(_local(s, d)[1])
    return rows.select("part", "dst", F.size("nbrs").cast("long").alias("deg"), F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs"))


@query
def label_gather(s, d):
    ids = subgraph.local_ids(_members(s, d)[1])
    return subgraph.gathered(ids, fx.features(s, d).select("node", "label")).select("part", "lid", "node", "label")


@query
def seed_local_ids(s, d):
    ids = subgraph.local_ids(_members(s, d)[1])
    return fx.seeds(s, d).join(ids, ["part", "node"]).select("part", "node", "lid")


@query
def partition_manifest(s, d):
    return subgraph.manifest(*_kept(s, d))


@query
def partition_extremes(s, d):
    return merge.extremes(_members(s, d)[1].groupBy("part").agg(F.count("*").alias("n")))


@query
def seeds_per_part(s, d):
    return fx.seeds(s, d).groupBy("part").agg(F.count("*").alias("n"), F.expr(f"(count(*) - 1) div {BATCH} + 1").alias("batches"))


@query
def reload_cost_matrix(s, d):
    return order.reload_cost(_members(s, d)[1])


@query
def visit_order(s, d):
    return order.visit_order(_members(s, d)[1])


@query
def epoch_schedule(s, d):
    return jobs.schedule(order.visit_order(_members(s, d)[1]), 3)


def _steps(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    members = _members(s, d)[1]
    return cut(subgraph.local_ids(members)), delta.steps(order.visit_order(members))


@query
def delta_same(s, d):
    return delta.same(*_steps(s, d))


@query
def delta_diff(s, d):
    return delta.pairing(*_steps(s, d))


@query
def delta_added(s, d):
    return delta.added(*_steps(s, d))


@query
def delta_added_features(s, d):
    loaded = delta.added(*_steps(s, d)).join(fx.features(s, d), "node")
    return loaded.select("from_part", "to_part", "node", F.posexplode("feat").alias("dim", "val")).withColumn("dim", F.col("dim").cast("long")).withColumn("val", F.round(F.col("val").cast("double"), 6))


@query
def slot_map_step(s, d):
    """The slot maps of all steps of the cycle."""
    members = _members(s, d)[1]
    return delta.slot_cycle(cut(subgraph.local_ids(members)), cut(order.visit_order(members)))


@query
def incremental_load(s, d):
    """Labels by part along the visiting order; each part looks up only what the one before it didn't hold."""
    members = _members(s, d)[1]
    ids, known, held, out = cut(subgraph.local_ids(members)), fx.features(s, d).select("node", "label"), None, None
    for row in order.visit_order(members).orderBy("seq").collect():
        here = ids.where(F.col("part") == row["part"])
        held = cut(delta.carried(held, here, known))
        rows = subgraph.gathered(here, held).select("part", "lid", "node", "label")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def memory_budget(s, d):
    return budget.over_budget(subgraph.manifest(*_kept(s, d)), 64, 60_000)


def _trimmed(s: SparkSession, d: str, kind: str = "sparse") -> tuple[DataFrame, DataFrame, DataFrame]:
    edges, members = _members(s, d, kind)
    ranked = subgraph.ranked_by_value(members, propagate.values(edges, fx.nodes(s, d), fx.seeds(s, d)))
    return edges, members, cut(budget.trim_nodes(ranked))


@query
def trim_nodes(s, d):
    return _trimmed(s, d)[2]


@query
def trim_degree(s, d):
    edges = fx.edges(s, d, "full").select(F.lit(0).cast("long").alias("part"), "src", "dst")
    kept = fx.nodes(s, d).select(F.lit(0).cast("long").alias("part"), "node", (F.col("node") % 5 != 0).alias("kept"))
    return budget.trim_edges(edges, kept).groupBy("dst").agg(F.count("*").alias("deg"), F.sum("src").alias("src_sum"))


@query
def trim_places(s, d):
    return budget.kept_places(_trimmed(s, d)[2]).where("place is not null")


@query
def trim_features(s, d):
    found = budget.kept_features(budget.kept_places(_trimmed(s, d)[2]), fx.features(s, d))
    return found.select("part", "place", "node", F.posexplode("feat").alias("dim", "val")).withColumn("dim", F.col("dim").cast("long")).withColumn("val", F.round(F.col("val").cast("double"), 6))


@query
def tier_init(s, d):
    return tiers.tier_init(_trimmed(s, d)[2])


@query
def tier_write(s, d):
    slots = cut(tiers.tier_init(_trimmed(s, d)[2]))
    rows = slots.select("part", "slot", F.col("node").alias("value"))
    updates = slots.where("slot % 3 = 0").select("part", "slot", (-F.col("node")).alias("value"))
    return tiers.tier_write(rows, updates, ["part", "slot"])


@query
def tier_swap(s, d):
    slots = cut(tiers.tier_init(_trimmed(s, d)[2]))
    return tiers.tier_swap(slots, slots.where("node % 3 = 0"))


def _batches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fx.edges(s, d, "mid"), cut(sampler.batches(fx.seeds(s, d), BATCH))


@query
def batch_assign(s, d):
    return _batches(s, d)[1]


def _sampled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges, rows = _batches(s, d)
    return rows, sampler.sample(edges, rows, FANOUTS)


def _hop(n: int) -> Query:
    def sample_hop(s, d):
        edges, rows = _batches(s, d)
        return sampler.sample(edges, rows, FANOUTS[:n]).where(F.col("hop") == n)

    sample_hop.__name__ = f"sample_hop{n}"
    return query(sample_hop)


for _n in (1, 2, 3):
    _hop(_n)


@query
def sample_fast_tier(s, d):
    edges, rows = _batches(s, d)
    return sampler.sample(edges, rows, FANOUTS[:1], fast=fx.nodes(s, d).where("node % 2 = 0"))


@query
def full_neighbours(s, d):
    edges, rows = _batches(s, d)
    return sampler.sample(edges, rows, [-1])


@query
def batch_remap(s, d):
    return sampler.remap(*_sampled(s, d))


@query
def block_edges(s, d):
    rows, drawn = _sampled(s, d)
    return sampler.blocks(drawn, sampler.remap(rows, drawn), len(FANOUTS))


@query
def batch_features(s, d):
    found = sampler.batch_features(sampler.remap(*_sampled(s, d)), fx.features(s, d))
    return found.select("batch", "lid", "node", F.posexplode("feat").alias("dim", "val")).withColumn("dim", F.col("dim").cast("long")).withColumn("val", F.round(F.col("val").cast("double"), 6))


@query
def batch_gather_by_slot(s, d):
    slots = fx.nodes(s, d).select("node", (2 * F.col("node") + 1).alias("slot"))
    store = fx.features(s, d).select((2 * F.col("node") + 1).alias("slot"), F.col("label").alias("value"))
    return sampler.gather_by_slot(sampler.remap(*_sampled(s, d)), slots, store)


@query
def range_feature_scan(s, d):
    n = fx.nodes(s, d).count()
    begin, end = slice_bounds(8, n)[2]
    found = feature_range(fx.features(s, d), begin, end)
    return found.select("node", F.posexplode("feat").alias("dim", "val")).withColumn("dim", F.col("dim").cast("long")).withColumn("val", F.round(F.col("val").cast("double"), 6))


@query
def slice_ids(s, d):
    nodes = fx.nodes(s, d)
    return slice_ids_(nodes, slice_bounds(8, nodes.count()))


@query
def zero_features(s, d):
    rows = zero_features_(s, fx.nodes(s, d).count(), 4)
    return rows.select("node", F.posexplode("feat").alias("dim", "val")).select("node", F.col("dim").cast("long").alias("dim"), F.col("val").cast("double").alias("val"))


@query
def synthetic_train_ids(s, d):
    return synthetic_dataset(s, fx.nodes(s, d).count(), 4)[2]


def _entries(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", F.posexplode("x").alias("dim", "val")).select("node", F.col("dim").cast("long").alias("dim"), (F.round("val", 6) + 0.0).alias("val"))


@query
def sage_mean_layer(s, d):
    w = layers.fixed_weights
    return _entries(layers.sage_mean(fx.edges(s, d, "mid"), fx.vectors(s, d), w(4, 64), w(4, 64, 5)))


@query
def gcn_norm_layer(s, d):
    return _entries(layers.gcn(fx.edges(s, d, "mid"), fx.vectors(s, d), layers.fixed_weights(4, 64)))


GAT_HEADS = [(layers.fixed_weights(4, 64, h), layers.fixed_weights(1, 4, h + 1)[0], layers.fixed_weights(1, 4, h + 2)[0]) for h in (0, 3)]


@query
def gat_attention_layer(s, d):
    return _entries(layers.gat(fx.edges(s, d, "mid"), fx.vectors(s, d), GAT_HEADS))


@query
def gat_eight_heads(s, d):
    w = layers.fixed_weights
    heads = [(w(4, 64, h), w(1, 4, h + 1)[0], w(1, 4, h + 2)[0]) for h in range(8)]
    return _entries(layers.gat(fx.edges(s, d, "mid"), fx.vectors(s, d), heads, "concat", "elu"))


def _scores(s: SparkSession, d: str) -> DataFrame:
    # Both layers join on src.
    w, edges = layers.fixed_weights, placed(fx.edges(s, d, "mid"), "src")
    hidden = cut(layers.sage_mean(edges, fx.vectors(s, d), w(8, 64), w(8, 64, 5), "relu"))
    return layers.sage_mean(edges, hidden, w(10, 8, 1), w(10, 8, 6))


@query
def layerwise_inference(s, d):
    return _entries(_scores(s, d))


@query
def argmax_predict(s, d):
    return layers.predictions(_scores(s, d))


@query
def accuracy_by_split(s, d):
    return layers.accuracy(layers.predictions(_scores(s, d)), fx.features(s, d).select("node", "label"), fx.splits(s, d))


@query
def gcn_inference(s, d):
    w, edges = layers.fixed_weights, placed(fx.edges(s, d, "mid"), "src")
    steps = [lambda x: layers.gcn(edges, x, w(8, 64), "relu"), lambda x: layers.gcn(edges, x, w(4, 8, 1))]
    return _entries(layers.inference(fx.vectors(s, d), steps))


@query
def gcn_log_softmax(s, d):
    """Two normalised-sum layers that end in log-probabilities."""
    w, edges = layers.fixed_weights, placed(fx.edges(s, d, "mid"), "src")
    steps = [lambda x: layers.gcn(edges, x, w(8, 64), "relu"), lambda x: layers.gcn(edges, x, w(4, 8, 1), "log_softmax")]
    return _entries(layers.inference(fx.vectors(s, d), steps))


def _evaluation(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Batches of the nodes to evaluate and their sampled edges."""
    chosen = fx.splits(s, d).where("split <> 'train'").select("node", F.lit(0).cast("long").alias("part"))
    rows = cut(sampler.batches(chosen, BATCH))
    return rows, sampler.sample(fx.edges(s, d, "mid"), rows, FANOUTS[:2])


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    """(node, x): scores of the nodes to evaluate, over sampled neighbours."""
    w = layers.fixed_weights
    rows, drawn = _evaluation(s, d)
    return layers.sampled_scores(rows, drawn, fx.vectors(s, d), [(w(8, 64), w(8, 64, 5), "relu"), (w(10, 8, 1), w(10, 8, 6), "none")])


@query
def sampled_scores(s, d):
    return _entries(_evaluated(s, d))


@query
def sampled_accuracy(s, d):
    found = layers.predictions(_evaluated(s, d).select("node", F.transform("x", lambda x: F.round(x, 9)).alias("x")))
    return layers.accuracy(found, fx.features(s, d).select("node", "label"), fx.splits(s, d))


GAT_LAST = [(layers.fixed_weights(4, 8, 2), layers.fixed_weights(1, 4, 6)[0], layers.fixed_weights(1, 4, 7)[0])]


@query
def gat_inference(s, d):
    edges = placed(fx.edges(s, d, "mid"), "src")
    steps = [lambda x: layers.gat(edges, x, GAT_HEADS, "concat", "elu"), lambda x: layers.gat(edges, x, GAT_LAST)]
    return _entries(layers.inference(fx.vectors(s, d), steps))


@query
def residual_sage_layer(s, d):
    w = layers.fixed_weights
    return _entries(layers.residual_sage(fx.edges(s, d, "mid"), layers.linear(fx.vectors(s, d), w(4, 64)), [(w(4, 4, 1), w(4, 4, 2))], [(w(3, 8, 3), [0.1] * 3)]))


@query
def mean_loss(s, d):
    return layers.mean_loss(_scores(s, d), fx.features(s, d).select("node", "label"))


@query
def parameter_count(s, d):
    w = layers.fixed_weights
    return layers.parameter_count(params_table(s, {"self1": w(8, 64), "neigh1": w(8, 64, 5), "self2": w(10, 8, 1), "neigh2": w(10, 8, 6)}))


@query
def train_softmax_head(s, d):
    x = training.smoothed(fx.edges(s, d, "mid"), fx.vectors(s, d), 2)
    rows = x.join(fx.features(s, d).select("node", "label"), "node").join(fx.splits(s, d).where("split = 'train'"), "node")
    _, losses = training.softmax_head(rows, 10)
    return s.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch long, loss double")


@query
def train_sage_network(s, d):
    edges, x = fx.edges(s, d, "mid"), fx.vectors(s, d)
    width = 64
    mean = layers.V.mean_of("x", width).alias("m")
    m = edges.join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(mean)
    rows = x.join(m, "node", "left").withColumn("m", F.coalesce("m", layers.V.literal([0.0] * width))).join(fx.features(s, d).select("node", "label"), "node")
    _, losses = training.train_sage(rows.select("x", "m", "label"), 16, 10)
    return s.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch long, loss double")


def _trained(s: SparkSession, d: str, net: networks.Network) -> DataFrame:
    """(epoch, loss) of training over the parts of the whole job."""
    done = jobs.partition(fx.edges(s, d), fx.nodes(s, d), fx.seeds(s, d).select("node"), fx.PARTS, ceiling=0.0)
    known = cut(fx.features(s, d).select("node", F.col("feat").cast("array<double>").alias("x"), "label"))
    _, losses = jobs.train(done, known, net, list(FANOUTS[:2]), BATCH, epochs=2, rate=0.02)
    return s.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch long, loss double")


@query
def train_sage_batches(s, d):
    return _trained(s, d, networks.network("sage", [64, 16, 10]))


@query
def train_gcn_batches(s, d):
    return _trained(s, d, networks.network("gcn", [64, 16, 10], drop=0.1))


@query
def train_gat_batches(s, d):
    return _trained(s, d, networks.network("gat", [64, 8, 10], heads=(4, 1), drop=0.1, drop_attention=0.1))


@query
def sampled_loss(s, d):
    """The mean loss of the nodes to evaluate, by the networks that train on blocks, at fixed weights."""
    w = lambda *a: networks.np.array(layers.fixed_weights(*a))
    net = networks.Network("sage", [[w(8, 64), w(8, 64, 5)], [w(10, 8, 1), w(10, 8, 6)]])
    rows, drawn = _evaluation(s, d)
    known = fx.features(s, d).select("node", F.col("feat").cast("array<double>").alias("x"), "label")
    found = networks.batch_gradients(net, *networks.batch_inputs(rows, drawn, sampler.remap(rows, drawn), known))
    return found.agg(F.sum("n").alias("n"), F.round(F.sum("loss") / F.sum("n"), 6).alias("loss"))


@query
def lp_split(s, d):
    return linkpred.lp_split(fx.edges(s, d, "mid"), 0.2)


@query
def lp_negatives(s, d):
    return linkpred.lp_negatives(linkpred.lp_split(fx.edges(s, d, "mid"), 0.2), fx.nodes(s, d).count(), 5)


@query
def lp_split_rows(s, d):
    """A row an edge with all its negatives, as splits are written."""
    drawn = linkpred.lp_negatives(linkpred.lp_split(fx.edges(s, d, "mid"), 0.2), fx.nodes(s, d).count(), 5)
    return linkpred.split_rows(drawn).withColumn("target_node_neg", F.array_join(F.col("target_node_neg").cast("array<string>"), ","))


@query
def partition_summary(s, d):
    """Nodes, interior nodes, boundary nodes and kept edges of each part: the flagship."""
    edges, members = _members(s, d)
    kept = subgraph.induced_edges(edges, _interior(members), fx.seeds(s, d)).groupBy("part").agg(F.count("*").alias("edges_kept"))
    sizes = members.groupBy("part").agg(F.count("*").alias("nodes"), F.count_if(F.col("hop") < 3).alias("interior"), F.count_if(F.col("hop") == 3).alias("boundary"))
    return sizes.join(kept, "part")
