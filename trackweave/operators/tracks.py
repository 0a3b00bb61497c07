"""Graph operators on tracks: forests of nodes linked from frame to frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import AXES, distance, points
from trackweave.functions.numbering import prefix_sums
from trackweave.operators import matching as mt
from trackweave.operators.components import connected
from trackweave.operators.hierarchy import best_parents, hierarchy
from trackweave.operators.spatial import radius_join, supported
from trackweave.plans.stages import Stages


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(movie, node_id, out_deg, in_deg) of all nodes."""
    out = edges.groupBy("movie", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("o"))
    inn = edges.groupBy("movie", F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = nodes.select("movie", "node_id").join(out, ["movie", "node_id"], "left").join(inn, ["movie", "node_id"], "left")
    return rows.select("movie", "node_id", F.coalesce("o", F.lit(0)).alias("out_deg"), F.coalesce("n", F.lit(0)).alias("in_deg"))


def forest(edges: DataFrame) -> DataFrame:
    """Each target's best edge (highest p, null lowest, then the smaller source): (movie, source_id, target_id, p)."""
    best = best_parents(edges, ["movie"], "source_id", "target_id", "p").withColumnsRenamed({"node": "target_id", "parent": "source_id"})
    return edges.join(best, ["movie", "source_id", "target_id"], "left_semi").select("movie", "source_id", "target_id", "p")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(movie, node_id, comp, n): the smallest node that edges, in whatever direction, link each node with, and how many of ``nodes`` they link.

    A node may have several parents, and edges may form cycles.
    """
    found = connected(edges, ["movie"], "source_id", "target_id")
    rows = nodes.select("movie", "node_id").join(found.withColumnRenamed("node", "node_id"), ["movie", "node_id"], "left")
    rows = rows.select("movie", "node_id", F.coalesce("comp", "node_id").alias("comp"))
    sizes = rows.groupBy("movie", "comp").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, ["movie", "comp"]).select("movie", "node_id", "comp", "n")


def long_tracks(nodes: DataFrame, tracks: DataFrame, least: int, keep_divisions: bool = True) -> DataFrame:
    """(movie, node_id, comp) of components with at least ``least`` nodes or, if wanted, a node with two children."""
    comp = components(nodes, tracks)
    forks = tracks.groupBy("movie", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    kept = comp.join(forks, ["movie", "node_id"]).select("movie", "comp", F.lit(True).alias("fork")).distinct()
    rows = comp.join(kept, ["movie", "comp"], "left")
    return rows.where((F.col("n") >= least) | (F.lit(keep_divisions) & F.coalesce("fork", F.lit(False)))).select("movie", "node_id", "comp")


def segments(nodes: DataFrame, edges: DataFrame, one_cycle: bool = False) -> DataFrame:
    """(movie, node_id, segment): chains of edges whose source has one child and whose target one parent, by their first node.

    A chain that is a cycle has no first node: each of its nodes is a segment of its own or, with ``one_cycle``, all those of a movie are one (-1).
    """
    one = edges.select("movie", "source_id", "target_id").distinct()
    outs = one.groupBy("movie", "source_id").agg(F.count(F.lit(1)).alias("o")).where("o = 1")
    ins = one.groupBy("movie", "target_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    chain = one.join(outs, ["movie", "source_id"], "left_semi").join(ins, ["movie", "target_id"], "left_semi")
    tree = hierarchy(chain.select("movie", F.col("target_id").alias("node"), F.col("source_id").alias("parent")), ["movie"])
    first = F.col("root_id") if one_cycle else F.when(F.col("depth") >= 0, F.col("root_id"))
    rows = nodes.select("movie", "node_id").join(tree.withColumnRenamed("node", "node_id"), ["movie", "node_id"], "left")
    return rows.select("movie", "node_id", F.coalesce(first, "node_id").alias("segment"))


def forks(edges: DataFrame) -> DataFrame:
    """(movie, u, d1, d2, p1, p2): sources of exactly two edges, the more probable daughter first, ties by id."""
    two = edges.groupBy("movie", F.col("source_id").alias("u")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("p", (-F.col("target_id")).alias("_n"), F.col("target_id").alias("id"))).alias("a"), F.min(F.struct("p", (-F.col("target_id")).alias("_n"), F.col("target_id").alias("id"))).alias("b"))
    return two.where("n = 2").select("movie", "u", F.col("a.id").alias("d1"), F.col("b.id").alias("d2"), F.col("a.p").alias("p1"), F.col("b.p").alias("p2"))


def with_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are an end of an edge; all nodes of a movie without any edge."""
    ends = edges.select("movie", F.col("source_id").alias("node_id")).unionByName(edges.select("movie", F.col("target_id").alias("node_id"))).distinct()
    bare = nodes.join(edges.select("movie").distinct(), "movie", "left_anti")
    return nodes.join(ends, ["movie", "node_id"], "left_semi").unionByName(bare)


def motions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(movie, i, j, t, dz, dy, dx, p): displacements of edges from one frame to the next, by the target's frame."""
    a, b = points(nodes, "i"), points(nodes, "j", -1)
    e = edges.select("movie", F.col("source_id").alias("i"), F.col("target_id").alias("j"), "p")
    rows = e.join(a, ["movie", "i"]).join(b.withColumnRenamed("t", "tj"), ["movie", "j"]).where("t = tj")
    return rows.select("movie", "i", "j", (F.col("t") + 1).cast("int").alias("t"), *((F.col(f"{c}_j") - F.col(f"{c}_i")).alias(f"d{c}") for c in AXES), "p")


def frame_velocity(nodes: DataFrame, edges: DataFrame, p_min: float = 0.5, least: int = 8) -> DataFrame:
    """(movie, t, vz, vy, vx) of every frame 0 .. last: median displacement of the sure edges into it that are no
    divisions, where there are at least ``least``, else 0."""
    single = edges.groupBy("movie", "source_id").agg(F.count(F.lit(1)).alias("o")).where("o = 1")
    m = motions(nodes, edges.where(F.col("p") > p_min).join(single, ["movie", "source_id"], "left_semi"))
    med = m.groupBy("movie", "t").agg(F.count(F.lit(1)).alias("n"), *(F.percentile(f"d{c}", F.lit(0.5)).alias(f"m{c}") for c in AXES))
    last = nodes.groupBy("movie").agg(F.max("t").alias("last"))
    spine = last.select("movie", F.explode(F.sequence(F.lit(0), "last")).alias("t"))
    rows = spine.join(med, ["movie", "t"], "left")
    return rows.select("movie", "t", *(F.when(F.col("n") >= least, F.col(f"m{c}")).otherwise(F.lit(0.0)).alias(f"v{c}") for c in AXES))


def drift(velocity: DataFrame) -> DataFrame:
    """(movie, t, sz, sy, sx): running sum of the frame velocities."""
    w = Window.partitionBy("movie").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return velocity.select("movie", "t", *(F.sum(f"v{c}").over(w).alias(f"s{c}") for c in AXES))


def smoothed(nodes: DataFrame, edges: DataFrame, window: int = 3, weight: float = 0.8) -> DataFrame:
    """(movie, node_id, z, y, x) in um, drawn to the line through the neighbours of the node's chain.

    Backward the walk goes on while a node has one predecessor, forward while one successor, over
    edges from frame to frame, at most ``window`` steps; with at least 3 points the place becomes
    (1 - weight) own + weight fitted.
    """
    e = motions(nodes, edges).select("movie", F.col("i").alias("a"), F.col("j").alias("b")).distinct()
    back = e.groupBy("movie", F.col("b").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("a").alias("to")).where("k = 1").drop("k")
    ahead = e.groupBy("movie", F.col("a").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("b").alias("to")).where("k = 1").drop("k")
    place = nodes.select("movie", F.col("node_id").alias("at"), *(F.col(f"{c}_um").alias(c) for c in AXES))
    start = nodes.select("movie", "node_id", F.col("node_id").alias("at"), F.lit(0).alias("dt"))
    every = start
    for step, sign in ((back, -1), (ahead, 1)):
        now = start
        for k in range(1, window + 1):
            now = now.join(step.withColumnRenamed("n", "at"), ["movie", "at"]).select("movie", "node_id", F.col("to").alias("at"), F.lit(sign * k).alias("dt"))
            every = every.unionByName(now)
    seen = every.join(place, ["movie", "at"])
    fit = seen.groupBy("movie", "node_id").agg(F.count(F.lit(1)).alias("n"), *(F.regr_intercept(c, "dt").alias(f"f{c}") for c in AXES), *(F.max(F.when(F.col("dt") == 0, F.col(c))).alias(c) for c in AXES))
    return fit.select("movie", "node_id", *(F.when((F.col("n") >= 3) & F.col(f"f{c}").isNotNull(), (1 - F.lit(weight)) * F.col(c) + F.lit(weight) * F.col(f"f{c}")).otherwise(F.col(c)).alias(c) for c in AXES))


def stabilised(nodes: DataFrame, edges: DataFrame, window: int = 3, weight: float = 0.8, p_min: float = 0.5, least: int = 8) -> DataFrame:
    """``smoothed`` in coordinates without the movie's drift, which is put back afterwards."""
    shift = drift(frame_velocity(nodes, edges, p_min, least))
    moved = nodes.join(shift, ["movie", "t"]).select("movie", "node_id", "t", *((F.col(f"{c}_um") - F.col(f"s{c}")).alias(f"{c}_um") for c in AXES), *(f"s{c}" for c in AXES))
    flat = smoothed(moved, edges, window, weight)
    return flat.join(moved.select("movie", "node_id", *(f"s{c}" for c in AXES)), ["movie", "node_id"]).select("movie", "node_id", *((F.col(c) + F.col(f"s{c}")).alias(c) for c in AXES))


def gap_pairs(nodes: DataFrame, edges: DataFrame, max_gap: int = 2, step: float = 4.0, exclusion: float | None = 2.5) -> DataFrame:
    """(movie, e, s, gap, d): ends and starts of tracks with ``gap`` frames missing between, within step (gap + 1).

    Ends have no child and two frames after them, starts no parent and two before; no
    node lies within ``exclusion``, if given, of a point interpolated between them.
    """
    deg = degrees(nodes, edges)
    last = nodes.groupBy("movie").agg(F.max("t").alias("last"))
    rows = nodes.join(deg, ["movie", "node_id"]).join(last, "movie")
    ends = rows.where("out_deg = 0 and t <= last - 2")
    starts = rows.where("in_deg = 0 and t >= 2")
    found = None
    for k in range(1, max_gap + 1):
        near = radius_join(points(ends, "e"), points(starts, "s", -(k + 1)), "e", "s", step * (k + 1)).withColumn("gap", F.lit(k))
        found = near if found is None else found.unionByName(near)
    pairs, _ = Stages(nodes.sparkSession, "gaps").write(found, "pairs")
    if exclusion is None:
        return pairs.select("movie", "e", "s", "gap", "d")
    between = pairs.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("gap"))))
    at = between.select("movie", (F.col("t") + F.col("k")).cast("int").alias("t"), "e", "s", "gap", *((F.col(f"{c}_e") + (F.col(f"{c}_s") - F.col(f"{c}_e")) * F.col("k") / (F.col("gap") + 1)).alias(f"{c}_q") for c in AXES), F.col("e").alias("q"))
    taken = radius_join(at, points(nodes, "n"), "q", "n", exclusion, "left_semi").select("movie", "e", "s", "gap").distinct()
    return pairs.join(taken, ["movie", "e", "s", "gap"], "left_anti").select("movie", "e", "s", "gap", "d")


def bridges(pairs: DataFrame) -> DataFrame:
    """One-to-one bridges (movie, e, s, gap, d) of ``gap_pairs``: shorter gaps first, then by (d, e, s), greedily.

    In each round the pairs that are first for both their ends are taken and the
    rest of these ends' pairs dropped, until no pair is left; that takes the same pairs as one sorted pass.
    Piles of ends and starts (``_piled``) are matched in one round.
    """
    stages = Stages(pairs.sparkSession, "bridges")
    left, path = stages.write(pairs.select("movie", "e", "s", "gap", "d"), "left")
    done: list[str] = []
    while not done or left.take(1):
        ends = _nearest(left, "e", "s")
        starts = _nearest(left, "s", "e")
        near, near_path = stages.write(left.join(ends, ["movie", "e", "gap", "d"]).join(starts, ["movie", "s", "gap", "d"]), "near")
        first = near.where("s = first_s and e = first_e").select("movie", "e", "s", "gap", "d")
        if near.where("n_s > 1 and n_e > 1").take(1):
            first = first.unionByName(_piled(near)).distinct()
        first, first_path = stages.write(first, "taken")
        done.append(first_path)
        left, new = stages.write(left.join(first.select("movie", "e"), ["movie", "e"], "left_anti").join(first.select("movie", "s"), ["movie", "s"], "left_anti"), "left")
        stages.drop(path, near_path)
        path = new
    return pairs.sparkSession.read.schema(first.schema).parquet(*done)


def _nearest(pairs: DataFrame, own: str, other: str) -> DataFrame:
    """(movie, own, gap, d, n_other, first_other): the least (gap, d) of each node's pairs, how many pairs have it and the smallest partner of these."""
    level = pairs.groupBy("movie", own, "gap", "d").agg(F.count(F.lit(1)).alias("n"), F.min(other).alias("first"))
    best = level.groupBy("movie", own).agg(F.min(F.struct("gap", "d", "n", "first")).alias("b"))
    return best.select("movie", own, "b.gap", "b.d", F.col("b.n").alias(f"n_{other}"), F.col("b.first").alias(f"first_{other}"))


def _piled(near: DataFrame) -> DataFrame:
    """(movie, e, s, gap, d) of piles: ends and starts of which each is nearest to all of the other side and to none else, as where all
    ends lie in one place and all starts in one.  A sorted pass gives the k-th end the k-th start."""
    key = ["movie", "gap", "d", "first_e", "first_s"]
    many = near.where("n_s > 1 and n_e > 1")
    rank = lambda by: F.row_number().over(Window.partitionBy(*key).orderBy(by)).alias("k")
    ends, starts = many.select(*key, "e", "n_s").distinct(), many.select(*key, "s", "n_e").distinct()
    full = many.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    full = full.join(ends.groupBy(*key).agg(F.count(F.lit(1)).alias("a"), F.max("n_s").alias("most_s")), key).join(starts.groupBy(*key).agg(F.count(F.lit(1)).alias("b"), F.max("n_e").alias("most_e")), key)
    full = full.where("n = a * b and most_s = b and most_e = a").select(*key)
    rows = ends.select(*key, "e", rank("e")).join(starts.select(*key, "s", rank("s")), [*key, "k"]).join(full, key, "left_semi")
    return rows.select("movie", "e", "s", "gap", "d")


def spaced(nodes: DataFrame, radius: float, score: str) -> DataFrame:
    """(movie, node_id): greedy suppression; the highest score of a frame first (ties: smaller id), others within the radius drop out.

    In each round the nodes that come first among their remaining neighbours stay and drop these, until no neighbours are left; the
    result is that of one sorted pass.  Rounds are as many as the longest chain of neighbours with falling scores needs.
    """
    stages = Stages(nodes.sparkSession, "spaced")
    rows = nodes.withColumn("_s", F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    near = radius_join(points(rows, "i", keep=("_s",)), points(rows, "j", keep=("_s",)), "i", "j", radius).where("i <> j")
    beats = (F.col("_s_j") > F.col("_s_i")) | ((F.col("_s_j") == F.col("_s_i")) & (F.col("j") < F.col("i")))
    near, _ = stages.write(near.where(beats).select("movie", F.col("i").alias("node_id"), F.col("j").alias("over")), "near")
    left = nodes.select("movie", "node_id")
    kept = None
    while True:
        first, _ = stages.write(left.join(near.select("movie", "node_id").distinct(), ["movie", "node_id"], "left_anti"), "first")
        kept = first if kept is None else kept.unionByName(first)
        if not near.take(1):
            return stages.result(kept)
        out, _ = stages.write(near.join(first.withColumnRenamed("node_id", "over"), ["movie", "over"], "left_semi").select("movie", "node_id").distinct(), "out")
        left, _ = stages.write(left.join(first, ["movie", "node_id"], "left_anti").join(out, ["movie", "node_id"], "left_anti"), "left")
        near, _ = stages.write(near.join(left, ["movie", "node_id"], "left_semi").join(left.withColumnRenamed("node_id", "over"), ["movie", "over"], "left_semi"), "near")


def weak_segments(nodes: DataFrame, edges: DataFrame, support: DataFrame, theta: float) -> DataFrame:
    """(movie, segment, n, share) of segments of which less than ``theta`` is supported."""
    rows = segments(nodes, edges).join(support, ["movie", "node_id"])
    share = rows.groupBy("movie", "segment").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("supported").cast("double")).alias("share"))
    return share.where(F.col("share") < theta)


def filled(nodes: DataFrame, bridges: DataFrame, last_ids: DataFrame, order: tuple[str, ...] = ("gap", "d", "e", "s")) -> tuple[DataFrame, DataFrame]:
    """What bridges (movie, e, s, gap, d) add: (movie, node_id, t, z_um, y_um, x_um), evenly between their ends, and (movie, source_id, target_id).

    New ids follow the movie's last one (movie, last_id), bridge by bridge in the given order and from its end to its start.
    """
    a = nodes.select("movie", F.col("node_id").alias("e"), "t", *(F.col(f"{c}_um").alias(f"{c}_e") for c in AXES))
    b = nodes.select("movie", F.col("node_id").alias("s"), *(F.col(f"{c}_um").alias(f"{c}_s") for c in AXES))
    rows = prefix_sums(bridges.withColumn("gap", F.col("gap").cast("long")), ["movie"], [F.col(c) for c in order], "gap", "upto")
    rows = rows.join(a, ["movie", "e"]).join(b, ["movie", "s"]).join(last_ids, "movie").withColumn("base", F.col("last_id") + F.col("upto") - F.col("gap"))
    rows, _ = Stages(nodes.sparkSession, "filled").write(rows, "bridges")
    steps = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gap"))))
    between = [(F.col(f"{c}_e") + (F.col(f"{c}_s") - F.col(f"{c}_e")) * F.col("k") / (F.col("gap") + 1)).alias(f"{c}_um") for c in AXES]
    new = steps.where("k > 0").select("movie", (F.col("base") + F.col("k")).alias("node_id"), (F.col("t") + F.col("k")).cast("int").alias("t"), *between)
    source = F.when(F.col("k") == 0, F.col("e")).otherwise(F.col("base") + F.col("k"))
    target = F.when(F.col("k") == F.col("gap"), F.col("s")).otherwise(F.col("base") + F.col("k") + 1)
    return new, steps.select("movie", source.alias("source_id"), target.alias("target_id"))


def close_gaps(nodes: DataFrame, edges: DataFrame, max_gap: int = 1, step: float = 8.0) -> DataFrame:
    """(movie, e, s, gap, d): ends matched with starts ``gap`` + 1 frames later within step (gap + 1): most bridges, then least distance.

    Shorter gaps come first; an end bridged there asks no more, a start may be met once for each length of gap.
    """
    stages = Stages(nodes.sparkSession, "close_gaps")
    rows, _ = stages.write(nodes.join(degrees(nodes, edges), ["movie", "node_id"]).where("out_deg = 0 or in_deg = 0"), "loose")
    ends, starts, found = rows.where("out_deg = 0"), rows.where("in_deg = 0"), None
    for gap in range(1, max_gap + 1):
        pairs = radius_join(points(ends, "i"), points(starts, "j", -(gap + 1)), "i", "j", step * (gap + 1)).select("movie", "i", "j", "d")
        part, _ = stages.write(mt.matched(pairs).select("movie", F.col("i").alias("e"), F.col("j").alias("s"), F.lit(gap).alias("gap"), "d"), "bridges")
        found = part if found is None else found.unionByName(part)
        ends = ends.join(part.select("movie", F.col("e").alias("node_id")), ["movie", "node_id"], "left_anti")
    return found


def track_gate(nodes: DataFrame, edges: DataFrame, spacing: DataFrame, second: DataFrame, sensitive: DataFrame, bands: list[tuple[float, float, str, float, float, float]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left when badly supported segments have been removed.

    ``spacing`` is (movie, spacing), 0 where null; a movie falls into the first band (lo, hi, mode, theta, r, r2) with lo <= spacing < hi,
    and one in no band keeps all.  In mode v a node is supported by a point of ``second`` within r, in mode or (and) by one of ``sensitive``
    within r or (and) one of ``second`` within r2, all of its frame.  Segments less than theta of whose nodes are supported go, with their edges.
    """
    stages = Stages(nodes.sparkSession, "track_gate")
    sp = spacing.groupBy("movie").agg(F.coalesce(F.max("spacing"), F.lit(0.0)).alias("_sp"))
    which = F.coalesce(*(F.when((F.col("_sp") >= lo) & (F.col("_sp") < hi), F.lit(k)) for k, (lo, hi, *_) in enumerate(bands)), F.lit(None).cast("int"))
    banded, _ = stages.write(sp.select("movie", which.alias("band")).where("band is not null"), "banded")
    inside, _ = stages.write(nodes.join(banded, "movie"), "inside")
    rows = None
    for k, (_, _, mode, theta, r, r2) in enumerate(bands):
        mine = inside.where(F.col("band") == k)
        if mode == "v":
            part = supported(mine, second, r)
        else:
            a, b = supported(mine, sensitive, r), supported(mine, second, r2).withColumnRenamed("supported", "also")
            ok = F.col("supported") | F.col("also") if mode == "or" else F.col("supported") & F.col("also")
            part = a.join(b, ["movie", "node_id"]).select("movie", "node_id", ok.alias("supported"))
        part = part.withColumn("theta", F.lit(theta))
        rows = part if rows is None else rows.unionByName(part)
    cut = segments(inside, edges.join(banded, "movie", "left_semi")).join(rows, ["movie", "node_id"])
    cut, _ = stages.write(cut, "cut")
    weak = cut.groupBy("movie", "segment").agg(F.avg(F.col("supported").cast("double")).alias("share"), F.max("theta").alias("theta")).where("share < theta")
    gone, _ = stages.write(cut.join(weak, ["movie", "segment"], "left_semi").select("movie", "node_id"), "gone")
    left = edges.join(gone.withColumnRenamed("node_id", "source_id"), ["movie", "source_id"], "left_anti").join(gone.withColumnRenamed("node_id", "target_id"), ["movie", "target_id"], "left_anti")
    return nodes.join(gone, ["movie", "node_id"], "left_anti"), left


def refined(second: DataFrame, first: DataFrame, radius: float = 6.0, least: float = 0.5) -> DataFrame:
    """(movie, node_id, comp, share, seed, size): points of ``second`` whose tracks are supported by ``first``.

    Points of a frame are matched one to one within ``radius``; ``second`` is linked from frame to frame, and components stay of which at least
    ``least`` is matched.  ``first`` has seed and size, which a matched point takes over; others get the median of their frame, and 1 and 0 where ``first`` has none.
    """
    stages = Stages(second.sparkSession, "refined")
    pairs = radius_join(points(second, "i"), points(first, "j"), "i", "j", radius).select("movie", "i", "j", "d")
    met, _ = stages.write(mt.matched(pairs).select("movie", F.col("i").alias("node_id"), F.col("j").alias("of")), "met")
    links, _ = stages.write(mt.link_frames(second).select("movie", F.col("i").alias("source_id"), F.col("j").alias("target_id")), "links")
    rows = components(second, links).join(met, ["movie", "node_id"], "left")
    rows, _ = stages.write(rows, "rows")
    share = rows.groupBy("movie", "comp").agg(F.avg(F.col("of").isNotNull().cast("double")).alias("share")).where(F.col("share") >= least)
    own = first.select("movie", F.col("node_id").alias("of"), F.col("seed").alias("_seed"), F.col("size").alias("_size"))
    typical = first.groupBy("movie", "t").agg(F.percentile("seed", F.lit(0.5)).alias("_mseed"), F.percentile("size", F.lit(0.5)).alias("_msize"))
    kept = rows.join(share, ["movie", "comp"]).join(second.select("movie", "node_id", "t"), ["movie", "node_id"]).join(own, ["movie", "of"], "left").join(typical, ["movie", "t"], "left")
    return kept.select("movie", "node_id", "comp", "share", F.coalesce("_seed", "_mseed", F.lit(1.0)).alias("seed"), F.coalesce("_size", "_msize", F.lit(0.0)).alias("size"))
