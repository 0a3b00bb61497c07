"""Pairwise matches to groups by low-diameter decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.skew import hot_keys, spread_join
from trackweave.plans.stages import Stages

#: With so many edges or fewer left, growth and contraction cost plans and jobs, in the driver's memory above all, for next to no rows.
FEW_EDGES = 200_000


def _start(by: list[str], level: int, beta: float) -> Column:
    """The exponentially shifted start time of a vertex, drawn from its hash: minus Exp(beta)."""
    h = F.xxhash64(*by, "node", F.lit(level))
    unit = (F.pmod(h, F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    return F.log(unit) / F.lit(beta)


def _grow(edges: DataFrame, by: list[str], level: int, beta: float, rounds: int, total: int) -> DataFrame:
    """(by, node, center): clusters grown from the start times for a number of rounds.

    A cluster reaches a vertex at its centre's start time plus the number of
    steps; the earliest takes it.  In each round only the frontier, the vertices taken in the last one, tells its neighbours.  A
    vertex keeps a centre only along paths of the graph, so a cluster never joins two components, however few the
    rounds, and whichever of two centres that come at one time takes it.
    """
    both = edges.select(*by, F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(*by, F.col("b").alias("node"), F.col("a").alias("to")))
    hot = hot_keys(both, [*by, "node"], 2 * total)
    start = _start(by, level, beta)
    labels = both.select(*by, "node").distinct().select(*by, "node", start.alias("at"), F.col("node").alias("center"), (start + 1).alias("had"))
    keys, parts = [*by, "node"], F.coalesce("parts", F.lit(1))
    if hot is not None:
        both = both.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64("to"), parts).cast("int")).drop("parts")
    salt = ["salt"] if hot is not None else []
    near = both.select(*(F.col(k).alias(f"_{k}") for k in [*keys, *salt]), "to")
    for _ in range(rounds):
        if hot is not None:
            labels = labels.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        # every vertex keeps what it has; those of the frontier meet their neighbours
        on = [F.col(k) == F.col(f"_{k}") for k in [*keys, *salt]] + [F.col("at") < F.col("had")]
        own = F.struct(F.col("node").alias("node"), F.col("at").alias("at"), F.col("at").alias("had"))
        told = F.struct(F.col("to").alias("node"), (F.col("at") + 1).alias("at"), F.lit(None).cast("double").alias("had"))
        heard = labels.join(near.hint("merge"), on, "left").select(*by, "center", F.explode(F.array(own, told)).alias("x")).where("x.node is not null")
        labels = heard.groupBy(*by, F.col("x.node").alias("node")).agg(F.min("x.at").alias("at"), F.min_by("center", "x.at").alias("center"), F.max("x.had").alias("had"))
    return labels.select(*by, "node", "center")


def _closed(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, center): whole components of FEW_EDGES edges or fewer, dealt to tasks by ``by``, which no component crosses."""
    schema = edges.select(*by, F.col("a").alias("node"), F.col("a").alias("center")).schema

    def close(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [x for x in parts if len(x)]
        if not found:
            return
        rows = pd.concat(found, ignore_index=True)
        ends = pd.concat([rows[[*by, end]].set_axis([*by, "node"], axis=1) for end in "ab"], ignore_index=True)
        code = ends.groupby([*by, "node"], sort=False).ngroup().to_numpy()
        ends = ends.drop_duplicates(ignore_index=True)  # in the order of their codes
        parent = list(range(len(ends)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(code[: len(rows)].tolist(), code[len(rows) :].tolist(), strict=True):
            parent[root(a)] = root(b)
        yield ends.assign(center=ends["node"].to_numpy()[[root(x) for x in range(len(ends))]])

    return (edges.repartition(*by) if by else edges.coalesce(1)).mapInPandas(close, schema)


def connected_groups(edges: DataFrame, by: list[str], a: str, b: str, beta: float = 0.25, rounds: int = 8) -> DataFrame:
    """(by, node, group_id) of every node that a pair links with another; group_id is the smallest node of the group.

    Level by level, vertices grow into clusters of low diameter from
    exponentially shifted start times; the clusters become the vertices of the next
    level, whose edges are the distinct ones between clusters, until FEW_EDGES or fewer are left, whose components are
    closed exactly within the tasks that ``by`` deals them to.
    The assignments are then composed from the top.  The smallest member is carried
    up with each contraction.  Hot vertices, when clusters grow and contract, and clusters of very many members, when assignments are
    composed, are spread over several tasks.

    Rows with a null, pairs of a node with itself and repeated pairs in either
    direction link nothing more; an empty table has no groups.  Everything is keyed by
    ``by``; columns besides those named are ignored.
    """
    stages = Stages(edges.sparkSession, "groups")
    now = edges.select(*by, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    for c in by:
        now = now.where(F.col(c).isNotNull())
    now, path, left = stages.counted(now.distinct(), "edges", F.lit(True))
    assigned: list[tuple[DataFrame, str, int]] = []
    while left or not assigned:
        few = left <= FEW_EDGES
        center = _closed(now, by) if few else _grow(now, by, len(assigned), beta, rounds, left)
        if assigned:
            center = center.join(_least(assigned[-1][0], by).withColumnRenamed("center", "node"), [*by, "node"])
        else:
            center = center.withColumn("least", F.col("node"))
        center, center_path, members = stages.counted(center, "assigned", F.lit(True))
        assigned.append((center, center_path, members))
        if few:
            break
        ca = center.select(*by, F.col("node").alias("a"), F.col("center").alias("ca"))
        cb = center.select(*by, F.col("node").alias("b"), F.col("center").alias("cb"))
        one = spread_join(now, ca, [*by, "a"], "b", total=left)
        between = spread_join(one, cb, [*by, "b"], "a", counted=now, total=left).where("ca <> cb").select(*by, F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        new, new_path, left = stages.counted(between, "edges", F.lit(True))
        stages.drop(path)
        now, path = new, new_path
    group, group_path = None, None
    for center, center_path, members in reversed(assigned):
        # of each cluster the group it came to lie in, else its own smallest member
        final = _least(center, by)
        if group is not None:
            final = final.join(group.withColumnsRenamed({"node": "center"}), [*by, "center"], "left").select(*by, "center", F.coalesce("group_id", "least").alias("least"))
        group = spread_join(center.select(*by, "node", "center"), final, [*by, "center"], "node", total=members).select(*by, "node", F.col("least").alias("group_id"))
        if center is not assigned[0][0]:
            group, new = stages.write(group, "group")
            stages.drop(center_path, *([group_path] if group_path else []))
            group_path = new
    return stages.result(group)


def _least(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Of each cluster the smallest node of the input among its members."""
    return assigned.groupBy(*by, "center").agg(F.min("least").alias("least"))
