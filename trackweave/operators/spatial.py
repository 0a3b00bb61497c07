"""Joins of points by distance within movies and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import AXES, distance, points
from trackweave.plans.stages import Stages


def radius_join(left: DataFrame, right: DataFrame, a: str, b: str, radius: float, how: str = "inner") -> DataFrame:
    """Pairs of ``left`` (movie, t, a, z_a, y_a, x_a) and ``right`` (same with b) of one movie and t with d <= radius.

    A grid join: one side lies in its own cell of twice the radius, the other in every cell that its reach
    touches, two along each axis and eight in all, so the join is a hash or merge join on movie, frame and cell, and no task
    meets a whole frame.  The exploded side's size is not known before it runs, so it is merged, never
    broadcast on a guess.  ``how`` may be inner, left_semi or left_anti.
    Points with a null place or frame match nothing.
    """
    keys = ["movie", "t"]
    for c in AXES:
        at, width = F.col(f"{c}_{b}"), 2 * radius
        reach = F.lit(radius * (1 + 1e-9)) + F.abs(at) * 1e-15  # rounding of a place at a cell's edge
        left = left.withColumn(f"_c{c}", F.floor(F.col(f"{c}_{a}") / width))
        right = right.withColumn(f"_c{c}", F.explode(F.sequence(F.floor((at - reach) / width), F.floor((at + reach) / width))))
        keys.append(f"_c{c}")
    drop = [f"_c{c}" for c in AXES]
    if how == "inner":
        return left.join(right.hint("merge"), keys).withColumn("d", distance(f"_{a}", f"_{b}")).where(F.col("d") <= radius).drop(*drop)
    other = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    on = [F.col(k) == F.col(f"{k}_r") for k in keys] + [distance(f"_{a}", f"_{b}") <= radius]
    return left.join(other.hint("merge"), on, how).drop(*drop)


def next_frame_pairs(nodes: DataFrame, radius: float = 10.0) -> DataFrame:
    """(movie, i, j, d): nodes i of a frame and j of the next at most ``radius`` apart."""
    return radius_join(points(nodes, "i"), points(nodes, "j", -1), "i", "j", radius).select("movie", "i", "j", "d")


def next_frame_nearest(nodes: DataFrame, k: int, of: str = "i", first: float = 20.0) -> DataFrame:
    """(movie, i, j, d): the k nearest successors of every i (``of='i'``) or predecessors of every j (``of='j'``).

    Equal distances go to the smaller id; a frame of fewer than k nodes gives all.
    The search radius doubles: a node with k others in reach is done, the rest ask again, and only who asks is copied to the cells around, so crowded frames
    never meet as a whole; who is still open when the radius spans the movies is done with what there is.
    """
    stages = Stages(nodes.sparkSession, "nearest")
    to = "j" if of == "i" else "i"
    shift = {"i": 0, "j": -1}
    asked, others = points(nodes, of, shift[of]), points(nodes, to, shift[to])
    extent = nodes.agg(*(F.max(f"{c}_um") - F.min(f"{c}_um") for c in AXES)).first()
    farthest = sum((v or 0.0) ** 2 for v in extent) ** 0.5
    present = others.groupBy("movie", "t").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("movie", of).orderBy("d", to))
    full = F.count(F.lit(1)).over(Window.partitionBy("movie", of)) >= F.least(F.lit(k), F.col("n"))
    found, radius = None, first
    asked, _ = stages.write(asked.join(present, ["movie", "t"]), "open")
    while True:
        pairs = radius_join(others, asked, to, of, radius).withColumn("rank", rank).where(F.col("rank") <= k)
        done, _ = stages.write(pairs.withColumn("full", full).where(F.col("full") | F.lit(radius >= farthest)).select("movie", "i", "j", "d"), "done")
        found = done if found is None else found.unionByName(done)
        if radius >= farthest:
            return found
        asked, _ = stages.write(asked.join(done.select("movie", of).distinct(), ["movie", of], "left_anti"), "open")
        if not asked.take(1):
            return found
        radius *= 2


def candidates(nodes: DataFrame, radius: float = 10.0, k: int = 5, k_in: int = 3) -> DataFrame:
    """(movie, i, j, d): pairs in reach, nearest successors and nearest predecessors, each pair once."""
    parts = [next_frame_pairs(nodes, radius), next_frame_nearest(nodes, k, "i"), next_frame_nearest(nodes, k_in, "j")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("movie", "i", "j").agg(F.min("d").alias("d"))


def nearest_in_frame(nodes: DataFrame, cap: float = 15.0) -> DataFrame:
    """(movie, node_id, nnd): distance of the nearest other node of the frame, at most ``cap``; ``cap`` if alone."""
    near = radius_join(points(nodes, "i"), points(nodes, "j"), "i", "j", cap).where("i <> j").groupBy("movie", "i").agg(F.min("d").alias("nnd"))
    return nodes.select("movie", "node_id").join(near.withColumnRenamed("i", "node_id"), ["movie", "node_id"], "left").select("movie", "node_id", F.coalesce("nnd", F.lit(cap)).alias("nnd"))


def nearest_distance(nodes: DataFrame, first: float = 20.0) -> DataFrame:
    """(movie, node_id, nnd): distance of the nearest other node of the frame, however far; none for a node alone in its frame.

    The radius doubles for those that found none, so crowded frames never meet as a whole.
    """
    stages = Stages(nodes.sparkSession, "nearest")
    crowd = nodes.groupBy("movie", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    asked, others, radius = points(nodes, "i").join(crowd.drop("n"), ["movie", "t"], "left_semi"), points(nodes, "j"), first
    asked, path, left = stages.counted(asked, "open", F.lit(True))
    found: list[str] = []
    while left or not found:
        near = radius_join(others, asked, "j", "i", radius).where("i <> j").groupBy("movie", F.col("i").alias("node_id")).agg(F.min("d").alias("nnd"))
        near, near_path = stages.write(near, "done")
        found.append(near_path)
        asked, path, left = stages.counted(asked.join(near.withColumnRenamed("node_id", "i"), ["movie", "i"], "left_anti"), "open", F.lit(True))
        radius *= 2
    return stages.result(nodes.sparkSession.read.schema(near.schema).parquet(*found))


def crowding(nodes: DataFrame, radius: float, shift: int = 0) -> DataFrame:
    """(movie, node_id, n): nodes within the radius, in the own frame without oneself or ``shift`` frames on."""
    near = radius_join(points(nodes, "i"), points(nodes, "j", -shift), "i", "j", radius)
    near = (near if shift else near.where("i <> j")).groupBy("movie", F.col("i").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("movie", "node_id").join(near, ["movie", "node_id"], "left").select("movie", "node_id", F.coalesce("n", F.lit(0)).alias("n"))


def crowding_next(nodes: DataFrame, radius: float) -> DataFrame:
    """``crowding`` in the next frame; where there is none, that of the own frame plus one."""
    frames = nodes.select("movie", (F.col("t") - 1).alias("t"), F.lit(True).alias("has_next")).distinct()
    own = crowding(nodes, radius).withColumnRenamed("n", "own")
    then = crowding(nodes, radius, 1).withColumnRenamed("n", "then")
    rows = nodes.select("movie", "t", "node_id").join(frames, ["movie", "t"], "left").join(own, ["movie", "node_id"]).join(then, ["movie", "node_id"])
    return rows.select("movie", "node_id", F.when(F.col("has_next"), F.col("then")).otherwise(F.col("own") + 1).alias("n"))


def supported(nodes: DataFrame, reference: DataFrame, radius: float) -> DataFrame:
    """(movie, node_id, supported): whether a reference point of the frame lies in reach; false in frames without any."""
    near = radius_join(points(nodes, "i"), points(reference, "j"), "i", "j", radius, "left_semi").select("movie", F.col("i").alias("node_id"), F.lit(True).alias("s"))
    return nodes.select("movie", "node_id").join(near, ["movie", "node_id"], "left").select("movie", "node_id", F.coalesce("s", F.lit(False)).alias("supported"))


def unlabelled(nodes: DataFrame, labels: DataFrame, radius: float = 4.0) -> DataFrame:
    """(movie, node_id) of nodes with no label of their frame within the radius."""
    return radius_join(points(nodes, "i"), points(labels, "j"), "i", "j", radius, "left_anti").select("movie", F.col("i").alias("node_id"))


def nearest_with_cap(nodes: DataFrame, shift: int, radius: float) -> DataFrame:
    """(movie, node_id, nearest, d): nearest node ``shift`` frames on within the radius, else -1 and null."""
    near = radius_join(points(nodes, "i"), points(nodes, "j", -shift), "i", "j", radius)
    best = near.groupBy("movie", F.col("i").alias("node_id")).agg(F.min(F.struct("d", "j")).alias("b"))
    rows = nodes.select("movie", "node_id").join(best, ["movie", "node_id"], "left")
    return rows.select("movie", "node_id", F.coalesce("b.j", F.lit(-1)).alias("nearest"), F.col("b.d").alias("d"))


def daughter_pairs(nodes: DataFrame, gate: float = 13.5, sister: tuple[float, float] = (4.5, 17.0), middle: float = 7.0, most_cos: float = 0.6, best: int = 8) -> DataFrame:
    """(movie, u, d1, d2, sis, mid, score): for each mother its best pairs of next-frame nodes.

    Both lie within ``gate`` of the mother, ``sister`` apart, their middle within ``middle`` of her, and the cosine between
    the ways to them is at most ``most_cos``; score = mid + 0.3 |sis - 8|, lowest first, ties by ids.
    """
    near = radius_join(points(nodes, "u"), points(nodes, "d1", -1), "u", "d1", gate).drop("d")
    other = near.select("movie", "u", F.col("d1").alias("d2"), *(F.col(f"{c}_d1").alias(f"{c}_d2") for c in AXES))
    both = near.join(other, ["movie", "u"]).where("d1 < d2").withColumn("sis", distance("_d1", "_d2"))
    for c in AXES:
        both = both.withColumn(f"{c}_m", (F.col(f"{c}_d1") + F.col(f"{c}_d2")) / 2)
    both = both.withColumn("mid", distance("_u", "_m")).where((F.col("sis") >= sister[0]) & (F.col("sis") <= sister[1]) & (F.col("mid") <= middle))
    way = lambda k, c: F.col(f"{c}_{k}") - F.col(f"{c}_u")
    dot = way("d1", "z") * way("d2", "z") + way("d1", "y") * way("d2", "y") + way("d1", "x") * way("d2", "x")
    both = both.where(dot / F.greatest(distance("_u", "_d1") * distance("_u", "_d2"), F.lit(1e-6)) <= most_cos)
    both = both.withColumn("score", F.col("mid") + F.lit(0.3) * F.abs(F.col("sis") - 8.0))
    rank = F.row_number().over(Window.partitionBy("movie", "u").orderBy("score", "d1", "d2"))
    return both.withColumn("rank", rank).where(F.col("rank") <= best).select("movie", "u", "d1", "d2", "sis", "mid", "score")


def clamped_window(nodes: DataFrame, half: int) -> DataFrame:
    """(movie, t, k, at): for each frame the frames t-half .. t+half, clamped to 0 .. the movie's last."""
    frames = nodes.select("movie", "t").distinct()
    last = nodes.groupBy("movie").agg(F.max("t").alias("last"))
    rows = frames.join(last, "movie").withColumn("k", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    return rows.select("movie", "t", "k", F.least(F.greatest(F.col("t") + F.col("k"), F.lit(0)), F.col("last")).alias("at"))
