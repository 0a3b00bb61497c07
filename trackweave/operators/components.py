"""Connected components by label merging with contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.skew import spread_join
from trackweave.operators.hierarchy import climb
from trackweave.plans.stages import Stages


def connected(edges: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, node, comp) of every node that an edge, in whatever direction, links with another; comp is the smallest of them.

    Every vertex points to its smallest neighbour where that is smaller than itself, so pointers end at
    local minima; doubled pointers find these, vertices become them, and the distinct edges between different ones are
    the next level's.  A vertex that stays without taking in another has a smaller neighbour on the next
    level, so two levels at least halve the vertices that still have edges.  The labels are composed from the top.
    Edges of a node with itself and rows with a null link nothing.
    """
    stages = Stages(edges.sparkSession, "components")
    now = edges.select(*by, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    for c in by:
        now = now.where(F.col(c).isNotNull())
    now, path = stages.write(now.distinct(), "edges")
    levels: list[DataFrame] = []
    left = 1
    while left:
        both = now.select(*by, F.col("b").alias("node"), F.col("a").alias("up")).unionByName(now.select(*by, F.col("a").alias("node"), F.col("a").alias("up")))
        links = both.groupBy(*by, "node").agg(F.min("up").alias("up"))
        links, _ = stages.write(links, "links")
        moving, _, _ = climb(stages, links.where("up < node").select(*by, "node", "up", F.lit(1).alias("hops")), by)
        ends = moving.select(*by, "node", F.col("top").alias("comp")).unionByName(links.where("up = node").select(*by, "node", F.col("up").alias("comp")))
        ends, _ = stages.write(ends, "ends")
        levels.append(ends)
        ca, cb = (ends.withColumnsRenamed({"node": k, "comp": f"c{k}"}) for k in "ab")
        half, half_path = stages.write(spread_join(now, ca, [*by, "a"], "b"), "half")
        between = spread_join(half, cb, [*by, "b"], "a").where("ca <> cb").select(*by, F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        new, new_path, left = stages.counted(between, "edges", F.lit(True))
        stages.drop(path, half_path)
        now, path = new, new_path
    found = levels[-1]
    for ends in reversed(levels[:-1]):
        over = found.select(*by, F.col("node").alias("comp"), F.col("comp").alias("_over"))
        found = spread_join(ends, over, [*by, "comp"], "node", "left").select(*by, "node", F.coalesce("_over", "comp").alias("comp"))
        if ends is not levels[0]:
            found, _ = stages.write(found, "found")
    return stages.result(found)
