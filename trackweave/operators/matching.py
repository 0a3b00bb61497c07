"""One-to-one matching of points of neighbouring frames."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.components import connected
from trackweave.operators.spatial import next_frame_pairs
from trackweave.plans.stages import Stages

PAIRS_A_GROUP = 20_000


def least_cost(i: np.ndarray, j: np.ndarray, cost: np.ndarray, alone: float) -> np.ndarray:
    """Places of the pairs (i, j), ends numbered from 0, that match ends one to one so that their costs and ``alone`` for each i left over
    are least in sum.

    Shortest augmenting paths over the pairs there are: memory grows with these, not with the product of the sides.  Costs are not negative.
    """
    order = np.argsort(i, kind="stable")
    starts = np.searchsorted(i[order], np.arange(i.max() + 2)).tolist()
    places, cols, costs = order.tolist(), j[order].tolist(), cost[order].tolist()
    n_cols = int(j.max()) + 1
    u = [0.0] * (len(starts) - 1)
    v: dict[int, float] = {}
    owner: dict[int, int] = {}
    taken: dict[int, tuple[int, int]] = {}
    for free in range(len(u)):
        reach: dict[int, float] = {}
        by: dict[int, tuple[int, int]] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, far = free, 0.0
        while True:
            # column n_cols + row stands for staying alone
            for k, c, w in [(k, cols[k], costs[k]) for k in range(starts[row], starts[row + 1])] + [(-1, n_cols + row, alone)]:
                step = far + w - u[row] - v.get(c, 0.0)
                if c not in done and step < reach.get(c, math.inf):
                    reach[c], by[c] = step, (row, k)
                    heapq.heappush(heap, (step, c))
            far, col = heapq.heappop(heap)
            while col in done:
                far, col = heapq.heappop(heap)
            done.add(col)
            if col not in owner:
                break
            row = owner[col]
        u[free] += far
        for c in done:
            if c in owner:
                u[owner[c]] += far - reach[c]
            v[c] = v.get(c, 0.0) + reach[c] - far
        while True:
            row, k = by[col]
            before = taken.get(row)
            owner[col], taken[row] = row, (col, k)
            if row == free:
                break
            col = before[0]
    return np.array([places[k] for _, k in taken.values() if k >= 0], dtype=int)


def gated(pairs: pd.DataFrame, similarity: bool = False) -> np.ndarray:
    """Places of the pairs (i, j, d) matched one to one: as many as can be, then with the least total distance.

    With ``similarity`` the sum of 1 / (1 + d) is the greatest instead, however many pairs that are.
    """
    i, j = (np.unique(pairs[c].to_numpy(), return_inverse=True)[1] for c in "ij")
    d = pairs["d"].to_numpy(dtype=float)
    return least_cost(i, j, d / (1 + d), 1.0) if similarity else least_cost(i, j, d, 1e6)


def islands(stages: Stages, pairs: DataFrame) -> DataFrame:
    """Adds ``island`` to pairs (movie, i, j): a label shared by all that share ends directly or through others.

    A node counts once as an i and once as a j, as even and odd numbers of one graph.
    """
    now, _ = stages.write(pairs, "pairs")
    ends = now.select("movie", (F.col("i") * 2).alias("a"), (F.col("j") * 2 + 1).alias("b"))
    found = connected(ends, ["movie"], "a", "b").where("node % 2 = 0").select("movie", F.expr("node div 2").alias("i"), F.col("comp").alias("island"))
    return now.join(found, ["movie", "i"])


def matched(pairs: DataFrame, similarity: bool = False, then: Callable[[pd.DataFrame, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The matched ones of the pairs (movie, i, j, d), with ``second`` false; pairs of all frames may come together.

    The pairs fall into islands that share no end, and matching each alone is exact.  An island
    of one pair is matched as it stands; the others are dealt by hash to groups of about PAIRS_A_GROUP pairs.
    ``then`` may name further pairs of an island, given those matched; these have ``second`` true.
    """
    stages = Stages(pairs.sparkSession, "matching")
    all_ = islands(stages, pairs.select("movie", "i", "j", "d"))
    sizes = all_.groupBy("movie", "island").agg(F.count(F.lit(1)).alias("size"))
    all_, _ = stages.write(all_.join(sizes, ["movie", "island"]), "sized")
    alone = all_.where("size = 1").select("movie", "i", "j", "d", F.lit(False).alias("second"))
    groups = max(1, math.ceil(all_.where("size > 1").count() / PAIRS_A_GROUP))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, one in pdf.groupby(["movie", "island"], sort=True):
            one = one.sort_values(["i", "j"]).reset_index(drop=True)
            first = gated(one, similarity)
            parts.append(one.iloc[first].assign(second=False))
            if then is not None:
                parts.append(one.iloc[then(one, first)].assign(second=True))
        return pd.concat(parts)[["movie", "i", "j", "d", "second"]]

    dealt = all_.where("size > 1").withColumn("g", F.pmod(F.xxhash64("movie", "island"), F.lit(groups)))
    return alone.unionByName(dealt.groupBy("g").applyInPandas(solve, "movie string, i bigint, j bigint, d double, second boolean"))


def second_children(gate: float, tolerance: float) -> Callable[[pd.DataFrame, np.ndarray], np.ndarray]:
    """Adoption: each unmatched j, in order, goes to the nearest i with exactly one child within the gate, if their distances
    differ by at most the tolerance; if they differ more it stays alone.  An i that has adopted takes no other."""

    def then(pairs: pd.DataFrame, first: np.ndarray) -> np.ndarray:
        i, j, d = pairs["i"].to_numpy(), pairs["j"].to_numpy(), pairs["d"].to_numpy()
        child = {i[k]: d[k] for k in first}
        taken = {j[k] for k in first}
        out = []
        for lone in sorted(set(j) - taken):
            open_ = [k for k in np.flatnonzero(j == lone) if d[k] <= gate and i[k] in child]
            if open_:
                k = min(open_, key=lambda k: (d[k], i[k]))
                if abs(d[k] - child[i[k]]) <= tolerance:
                    out.append(k)
                    del child[i[k]]
        return np.array(out, dtype=int)

    return then


def link_frames(nodes: DataFrame, gate: float = 7.0, second_gate: float | None = 7.0, tolerance: float = 1.5) -> DataFrame:
    """(movie, i, j, d, second): nodes of each frame linked with those of the next, then second children adopted."""
    then = second_children(second_gate, tolerance) if second_gate is not None else None
    return matched(next_frame_pairs(nodes, gate), then=then)
