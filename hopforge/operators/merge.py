"""Cost-bounded merging of overlapping parts.

All sizes come from one aggregate: how many nodes have each set of parts. The
merge loop runs on that small table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopforge.plans.lineage import cut

#: Width of a feature row and ceiling of a part, in MB.
FEATURES, CEILING = 100, 12_000.0
#: Sets of parts that the driver may hold.
MOST_SETS = 1_000_000


def cost_mb(nodes: float, avg_degree: float, features: int = FEATURES) -> float:
    """MB that a part of so many nodes needs: edges and features, four bytes each."""
    return (nodes * avg_degree + nodes * features) * 4 / 1048576


def part_sets(members: DataFrame) -> DataFrame:
    """(parts, n): how many nodes are in exactly these parts; the array is sorted.

    The result is small and read several times, so it is cut off.
    """
    return cut(members.groupBy("node").agg(F.sort_array(F.collect_set("part")).alias("parts")).groupBy("parts").agg(F.count("*").alias("n")))


def pair_costs(members: DataFrame, avg_degree: float, features: int = FEATURES) -> DataFrame:
    """(a, b, n_union, n_both, cost) of all pairs of parts, a < b."""
    sets = part_sets(members).select("parts", "n")
    sizes = sets.select(F.explode("parts").alias("p"), "n").groupBy("p").agg(F.sum("n").alias("size"))
    both = sets.select(F.explode("parts").alias("a"), "parts", "n").select("a", F.explode("parts").alias("b"), "n").where("a < b").groupBy("a", "b").agg(F.sum("n").alias("n_both"))
    # All pairs of parts, of which there are few: parts, not rows.
    ids = [r[0] for r in sizes.select("p").orderBy("p").collect()]
    pairs = members.sparkSession.createDataFrame([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]], "a long, b long")
    known = pairs.join(both, ["a", "b"], "left").join(sizes.select(F.col("p").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("p").alias("b"), F.col("size").alias("sb")), "b")
    known = known.withColumn("n_both", F.coalesce("n_both", F.lit(0)).cast("long")).withColumn("n_union", F.col("sa") + F.col("sb") - F.col("n_both"))
    cost = (F.col("n_union") * F.lit(avg_degree) + F.col("n_union") * F.lit(features)) * 4 / 1048576
    return known.select("a", "b", "n_union", "n_both", F.round(cost, 6).alias("cost"))


Sets = list[tuple[frozenset, int]]
Strategy = Callable[[Sets, list[int], float, float, int], dict[int, tuple[int, int]]]


def merge_levels(sets: Sets, parts: list[int], avg_degree: float, ceiling: float, features: int = FEATURES) -> dict[int, tuple[int, int]]:
    """part -> (merged part, weight), level by level.

    At level l, while two parts or more have weight l, the cheapest and the
    dearest of them are tried. If their union costs too much both gain one
    weight and the level ends; else they become the one of smaller index with
    twice the weight. Ties go to the smaller index.
    """
    home, weight = {p: p for p in parts}, dict.fromkeys(parts, 1)

    def cost(*of: int) -> float:
        return cost_mb(sum(n for s, n in sets if any(home[p] in of for p in s)), avg_degree, features)

    for level in range(1, int(math.log2(len(parts))) + 1 if parts else 1):
        while len(same := sorted(p for p, w in weight.items() if w == level)) > 1:
            costs = {p: cost(p) for p in same}
            low = min(same, key=lambda p: (costs[p], p))
            high = min((p for p in same if p != low), key=lambda p: (-costs[p], p))
            if cost(low, high) > ceiling:
                weight[low] += 1
                weight[high] += 1
                break
            stays, goes = min(low, high), max(low, high)
            home = {p: stays if h == goes else h for p, h in home.items()}
            weight[stays] *= 2
            del weight[goes]
    return {p: (home[p], weight[home[p]]) for p in parts}


#: Merge strategies by name.
STRATEGIES: dict[str, Strategy] = {"cheapest_with_dearest": merge_levels}


def merge_plan(members: DataFrame, avg_degree: float, ceiling: float = CEILING, features: int = FEATURES, strategy: str = "cheapest_with_dearest") -> DataFrame:
    """(part, merged_part, weight). Only the counts by set of parts reach the driver.

    These are as many as there are different sets; more than MOST_SETS are an
    error, since every try of a merge goes through them.
    """
    held = part_sets(members)
    if (n := held.count()) > MOST_SETS:
        raise ValueError(f"nodes lie in {n} different sets of parts, more than {MOST_SETS}")
    sets = [(frozenset(r[0]), r[1]) for r in held.collect()]
    parts = sorted({p for s, _ in sets for p in s})
    plan = STRATEGIES[strategy](sets, parts, avg_degree, ceiling, features)
    return members.sparkSession.createDataFrame([(p, *plan[p]) for p in parts], "part long, merged_part long, weight long")


def merged(members: DataFrame, plan: DataFrame, hops: int = 3) -> DataFrame:
    """(part, node, hop, is_boundary) of merged parts.

    A node is boundary in a merged part if it is in every part of it that
    holds the node; hop is the smallest.
    """
    moved = members.join(plan.select("part", "merged_part"), "part")
    return moved.groupBy(F.col("merged_part").alias("part"), "node").agg(F.min("hop").alias("hop"), F.bool_and(F.col("hop") == hops).alias("is_boundary"))


def extremes(sizes: DataFrame) -> DataFrame:
    """One row: the smallest and the largest part of (part, n), ties to the smaller id, and the largest n."""
    low, high = F.min(F.struct("n", "part")), F.min(F.struct((-F.col("n")).alias("n"), "part"))
    return sizes.agg(low["part"].alias("min_part"), high["part"].alias("max_part"), F.max("n").alias("max_n"))
