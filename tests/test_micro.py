"""Hand-worked graphs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopforge.operators import budget, cluster, degrees, delta, linkpred, merge, order, propagate, sampler, subgraph, tiers
from hopforge.plans import jobs, placement

EDGES = [(2, 0), (3, 0), (3, 1), (4, 2), (5, 3), (6, 4), (6, 5), (7, 6), (0, 2), (8, 7), (1, 9)]
SEEDS = [(0, 0), (1, 1), (9, 2)]


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    seeds = spark.createDataFrame(SEEDS, "node long, part long")
    nodes = spark.range(10).withColumnRenamed("id", "node")
    return edges, nodes, seeds, propagate.membership(edges, seeds)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_degrees(graph):
    edges, nodes, _, _ = graph
    found = rows(degrees.degrees(edges, nodes), "node", "indeg")
    assert [d for _, d in found] == [2, 1, 2, 1, 1, 1, 1, 1, 0, 1]


def test_membership(graph):
    want = {0: {0: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}, 1: {1: 0, 3: 1, 5: 2, 6: 3}, 2: {9: 0, 1: 1, 3: 2, 5: 3}}
    assert rows(graph[3], "part", "node", "hop") == sorted((p, n, h) for p, x in want.items() for n, h in x.items())


@pytest.mark.parametrize(
    ("rounds", "want"),
    [
        (1, [100000, 200000, 50000, 150000, 0, 0, 0, 0, 0, 100000]),
        (2, [125000, 300000, 100000, 400000, 25000, 150000, 0, 0, 0, 100000]),
        (3, [175000, 400000, 162500, 762500, 75000, 550000, 175000, 0, 0, 100000]),
    ],
)
def test_values(graph, rounds, want):
    edges, nodes, seeds, _ = graph
    assert [v for _, v in rows(propagate.values(edges, nodes, seeds, rounds), "node", "value")] == want


def test_kept_edges_and_order_of_values(graph):
    edges, nodes, seeds, members = graph
    interior = members.where("hop < 3").select("part", "node")
    kept = rows(subgraph.induced_edges(edges, interior, seeds), "part", "src", "dst")
    want = {0: [(0, 0), (2, 0), (3, 0), (4, 2), (5, 3), (6, 4), (6, 5), (0, 2)], 1: [(1, 1), (3, 1), (5, 3), (6, 5)], 2: [(9, 9), (3, 1), (5, 3), (1, 9)]}
    assert kept == sorted((p, *e) for p, es in want.items() for e in es)
    assert subgraph.closure_violations(edges, members, interior).count() == 0
    ranked = subgraph.ranked_by_value(members, propagate.values(edges, nodes, seeds))
    by_part = {p: [n for _, _, n in rows(ranked.where(F.col("part") == p), "part", "rank", "node")] for p in range(3)}
    assert by_part == {0: [3, 5, 0, 6, 2, 4], 1: [3, 5, 1, 6], 2: [3, 5, 1, 9]}


def test_reload_order_and_delta(spark, graph):
    members = graph[3]
    cost = {(i, j): c for i, j, c in order.reload_cost(members).collect()}
    assert [[cost[i, j] for j in range(3)] for i in range(3)] == [[0, 1, 2], [3, 0, 1], [4, 1, 0]]
    path = order.visit_order(members)
    assert rows(path, "seq", "part", "path_cost") == [(0, 0, 2), (1, 1, 2), (2, 2, 2)]
    ids, step = subgraph.local_ids(members), delta.steps(path)
    same = delta.same(ids, step)
    assert rows(same.where("from_part = 0"), "prev_pos", "next_pos") == [(2, 1), (4, 2), (5, 3)]
    pairs = rows(delta.pairing(ids, step), "from_part", "k", "prev_pos", "next_pos")
    assert [(p, n) for f, _, p, n in pairs if f == 0] == [(0, 0), (1, 4), (3, 5)]
    loaded = rows(delta.added(ids, step), "from_part", "node")
    assert loaded == [(0, 1), (1, 9), (2, 0), (2, 2), (2, 4), (2, 6)]


def test_merged_boundary(spark, graph):
    for pair, size in (((0, 1), 7), ((0, 2), 8), ((1, 2), 5)):
        plan = spark.createDataFrame([(pair[0], 0), (pair[1], 0)], "part long, merged_part long")
        found = merge.merged(graph[3], plan)
        assert found.count() == size
        assert rows(found.where("is_boundary"), "node") == [(6,)]


@pytest.mark.parametrize(("parts", "weights"), [(2, [2]), (4, [4]), (8, [4, 4]), (16, [8, 8]), (30, [2, 4, 8, 8, 8]), (32, [8, 8, 8, 8])])
def test_merge_levels(parts, weights):
    sets = [(frozenset([p]), 10 + p) for p in range(parts)]
    plan = merge.merge_levels(sets, list(range(parts)), 2.0, 1e9)
    assert sorted(dict(plan.values()).values()) == weights


def test_ceiling_stops_merging():
    sets = [(frozenset([p]), 1000) for p in range(4)]
    plan = merge.merge_levels(sets, [0, 1, 2, 3], 2.0, merge.cost_mb(1500, 2.0))
    assert {p: m for p, (m, _) in plan.items()} == {0: 0, 1: 1, 2: 2, 3: 3}


@settings(deadline=None, max_examples=60)
@given(st.integers(2, 6), st.randoms(use_true_random=False))
def test_cheapest_path_is_the_first_of_the_cheapest(n, rnd):
    from itertools import permutations

    cost = {(i, j): 0 if i == j else rnd.randrange(4) for i in range(n) for j in range(n)}
    want = min((sum(cost[a, b] for a, b in zip(p, p[1:], strict=False)), list(p)) for p in permutations(range(n)))
    assert order.cheapest_path(cost) == want


def test_slots_stay_a_permutation(spark):
    rnd = random.Random(4)
    for _ in range(3):
        parts = [sorted(rnd.sample(range(30), rnd.randrange(3, 15))) for _ in range(3)]
        members = spark.createDataFrame([(p, n) for p, x in enumerate(parts) for n in x], "part long, node long")
        ids = subgraph.local_ids(members)
        step = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "from_part long, to_part long")
        longest = max(map(len, parts))
        slots, store = {i: i for i in range(longest)}, dict(enumerate(parts[0]))
        same, pairs, new = (df.collect() for df in (delta.same(ids, step), delta.pairing(ids, step), delta.added(ids, step)))
        for a in range(3):
            moved = {r.next_pos: slots[r.prev_pos] for r in [*same, *pairs] if r.from_part == a}
            assert sorted(moved.values()) == list(range(longest))
            slots = moved
            for r in new:
                if r.from_part == a:
                    store[slots[r.next_pos]] = r.node
            assert [store[slots[i]] for i in range(len(parts[(a + 1) % 3]))] == parts[(a + 1) % 3]


def test_tier_write_and_swap(spark):
    slots = spark.createDataFrame([(0, i, s) for i, s in enumerate([-1, -2, 1, 2, 3, -3, -4, -5, 4, 5, 6])], "part long, node long, slot long")
    wanted = spark.createDataFrame([(0, n) for n in (0, 1, 2, 3, 6, 7)], "part long, node long")
    found = [s for _, s in rows(tiers.tier_swap(slots, wanted), "node", "slot")]
    assert found == [3, 4, 1, 2, -1, -3, 5, 6, -2, -4, -5]
    store = spark.createDataFrame([(-i, 4 + i) for i in range(1, 7)] + [(i, 10 + i) for i in range(1, 7)], "slot long, value long")
    new = spark.createDataFrame(list(zip([-1, -3, 2, 4, 1, 3, -2], range(20, 27), strict=True)), "slot long, value long")
    after = dict(rows(tiers.tier_write(store, new), "slot", "value"))
    assert [after[-i] for i in range(1, 7)] == [20, 26, 21, 8, 9, 10]
    assert [after[i] for i in range(1, 7)] == [24, 22, 25, 23, 15, 16]


def test_trim_cuts_rows_of_sixty(spark):
    edges = spark.createDataFrame([(0, s, 0) for s in range(60)] + [(0, s, 1) for s in range(59)], "part long, src long, dst long")
    kept = spark.createDataFrame([(0, 0, True), (0, 1, True)], "part long, node long, kept boolean")
    assert rows(budget.trim_edges(edges, kept).groupBy("dst").count(), "dst", "count") == [(0, 30), (1, 59)]


def test_sampling_repeats_and_short_batches(spark):
    edges = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (4, 2)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "node long, part long")
    batch = sampler.batches(seeds, 2)
    assert rows(batch.groupBy("batch").count(), "batch", "count") == [(0, 2), (1, 1)]
    start = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "batch long, pos long, node long")
    drawn = sampler.sample(edges, start, [-1, -1])
    assert drawn.where("hop = 2 and src = 4").count() == 2
    ids = sampler.remap(start, drawn)
    assert rows(ids, "lid", "node")[:2] == [(0, 0), (1, 1)]
    assert rows(sampler.blocks(drawn, ids, 2).groupBy("depth").count(), "depth", "count") == [(1, 4), (2, 6)]


def test_hubs_are_kept_apart(graph, monkeypatch):
    edges, nodes, seeds, members = graph
    monkeypatch.setattr(propagate, "place", lambda df, key: placement.place(df, key, hub=1))
    assert placement.place(edges, "dst", hub=1).heavy.count() == 4
    assert rows(propagate.membership(edges, seeds), "part", "node", "hop") == rows(members, "part", "node", "hop")
    assert [v for _, v in rows(propagate.values(edges, nodes, seeds), "node", "value")] == [175000, 400000, 162500, 762500, 75000, 550000, 175000, 0, 0, 100000]


def test_placed_edges_are_not_shuffled_again(spark, graph):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        light = placement.place(graph[0], "dst").light
        plan = light.join(graph[1].withColumnRenamed("node", "dst"), "dst")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    nodes = spark.range(3).withColumnRenamed("id", "node")
    seeds = spark.createDataFrame([(0, 0)], "node long, part long")
    assert rows(propagate.membership(edges, seeds), "node") == [(0,)]
    assert rows(propagate.values(edges, nodes, seeds), "value") == [(0,), (0,), (100000,)]
    assert rows(cluster.seed_labels(edges, seeds), "label") == [(0,)]
    assert linkpred.lp_split(edges, 0.5).count() == 0


def test_whole_job(spark, tmp_path):
    rnd = random.Random(2)
    edges = spark.createDataFrame([(rnd.randrange(60), rnd.randrange(60)) for _ in range(150)], "src long, dst long").where("src <> dst")
    nodes = spark.range(60).withColumnRenamed("id", "node")
    done = jobs.partition(edges, nodes, nodes.where("node % 6 = 0"), 3, ceiling=0.0)
    jobs.save(done, str(tmp_path / "out"))
    manifest = done.manifest.collect()
    assert sorted(r.seq for r in manifest) == list(range(len(manifest)))
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == sum(r.n_edges for r in manifest)
    assert jobs.load(spark, str(tmp_path / "out"), "ids", 0).count() == manifest[[r.part for r in manifest].index(0)].n_nodes
    assert jobs.schedule(done.manifest, 2).count() == 2 * len(manifest)
    batch, drawn, ids = jobs.batch_tables(done, [2, 2], 4)
    assert ids.join(batch, ["batch", "node"]).where("lid <> pos").count() == 0
    assert drawn.groupBy("batch", "hop", "occ").count().where("count > 2").count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_branch_and_bound_equals_dynamic_programming(seed, monkeypatch):
    rnd = random.Random(seed)
    n = rnd.randrange(1, 8)
    cost = {(i, j): 0 if i == j else rnd.randrange(1, 6) for i in range(n) for j in range(n)}
    want = order.cheapest_path(cost)
    monkeypatch.setattr(order, "MOST", 0)
    assert order.cheapest_path(cost) == want


def test_numbers_over_many_ranges(spark):
    from hopforge.functions.ordering import numbered

    rows = [(p, n, n % 7) for p, size in ((1, 500), (2, 3), (3, 0), (4, 200)) for n in range(size)]
    frame = spark.createDataFrame(rows, "part long, node long, deg long").repartition(7)
    got = {(r.part, r.node): (r.rank, r.upto) for r in numbered(frame, ["part"], ["node"], value="deg").collect()}
    want, at = {}, {}
    for p, n, d in rows:
        at[p] = at.get(p, 0) + d
        want[p, n] = (n + 1, at[p])
    assert got == want
