"""Visiting order of parts that reloads the fewest nodes."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopforge.operators.merge import part_sets


#: Parts up to which all sets of them are looked at, and steps of the search beyond.
MOST, STEPS = 14, 5_000_000


def reload_cost(members: DataFrame) -> DataFrame:
    """(i, j, cost): nodes of part j that part i doesn't hold, for all pairs; 0 on the diagonal."""
    sets = part_sets(members)
    sizes = sets.select(F.explode("parts").alias("j"), "n").groupBy("j").agg(F.sum("n").alias("size"))
    both = sets.select(F.explode("parts").alias("i"), "parts", "n").select("i", F.explode("parts").alias("j"), "n").groupBy("i", "j").agg(F.sum("n").alias("both"))
    # All pairs of parts, of which there are few.
    ids = [r[0] for r in sizes.select("j").orderBy("j").collect()]
    pairs = members.sparkSession.createDataFrame([(i, j) for i in ids for j in ids], "i long, j long")
    return pairs.join(sizes, "j").join(both, ["i", "j"], "left").select("i", "j", (F.col("size") - F.coalesce("both", F.lit(0))).alias("cost"))


def cheapest_path(cost: dict[tuple[int, int], int]) -> tuple[int, list[int]]:
    """(cost, order) of the cheapest path through all parts; of equals the smallest in dictionary order.

    By dynamic programming over sets of parts up to MOST parts; beyond them
    by branch and bound, which is exact too but may take long where all costs
    are alike: past STEPS steps it gives up with an error.
    """
    parts = sorted({i for i, _ in cost})
    if len(parts) > MOST:
        return _bounded(cost, parts)

    @cache
    def rest(at: int, left: frozenset) -> tuple[int, tuple[int, ...]]:
        if not left:
            return 0, ()
        options = []
        for j in sorted(left):
            more, path = rest(j, left - {j})
            options.append((cost[at, j] + more, (j, *path)))
        return min(options)

    best = min(((c, (p, *path)) for p in parts for c, path in [rest(p, frozenset(parts) - {p})]), default=(0, ()))
    return best[0], list(best[1])


def _bounded(cost: dict[tuple[int, int], int], parts: list[int]) -> tuple[int, list[int]]:
    """As cheapest_path, depth first in ascending order of parts, so the first of the cheapest paths is met first.

    A path is left when it and the cheapest ways into all parts still to come
    can't be cheaper than the best so far.
    """
    into = {j: min(c for (i, k), c in cost.items() if k == j != i) for j in parts}
    best, order, steps = _greedy(cost, parts) + 1, [], 0
    stack = [((p,), 0, sum(into.values()) - into[p]) for p in reversed(parts)]
    while stack:
        path, so_far, least = stack.pop()
        if so_far + least >= best:
            continue
        if len(path) == len(parts):
            best, order = so_far, list(path)
            continue
        steps += 1
        if steps > STEPS:
            raise ValueError(f"no order of {len(parts)} parts was proved cheapest in {STEPS} steps")
        held = set(path)
        stack += [((*path, j), so_far + cost[path[-1], j], least - into[j]) for j in reversed(parts) if j not in held]
    return best, order


def _greedy(cost: dict[tuple[int, int], int], parts: list[int]) -> int:
    """The cost of the best path that always takes the cheapest next part: a bound to start from."""
    totals = []
    for p in parts:
        at, left, total = p, set(parts) - {p}, 0
        while left:
            j = min(left, key=lambda j: (cost[at, j], j))
            total, at = total + cost[at, j], j
            left.remove(j)
        totals.append(total)
    return min(totals)


def visit_order(members: DataFrame) -> DataFrame:
    """(seq, part, path_cost). Only one number per pair of parts reaches the driver."""
    total, path = cheapest_path({(i, j): c for i, j, c in reload_cost(members).collect()})
    return members.sparkSession.createDataFrame([(k, p, total) for k, p in enumerate(path)], "seq long, part long, path_cost long")
