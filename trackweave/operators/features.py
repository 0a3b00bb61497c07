"""Named feature columns of links and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import AXES, cosine, distance, points, safe_div
from trackweave.operators import links as lk
from trackweave.operators import matching as mt
from trackweave.operators import spatial as sp
from trackweave.plans.stages import Stages, scope

CAP = 15.0


def flow(nodes: DataFrame, nnd: DataFrame, first_pass: DataFrame, short: float = 6.0, widest: float = 45.0) -> DataFrame:
    """(movie, i, fz, fy, fx, tis_n): median displacement of short first-pass links of the frame around each node.

    Around means within 3 max(nnd, 4), without the node itself; with fewer than two there is none.
    Nodes ask by classes of radius, each with cells of its own width and each node copied in one class only, so those of crowded places don't meet their whole frame;
    ``nnd`` is at most ``widest`` / 3.
    """
    at = points(nodes, "j", -1).drop("t").join(first_pass.where(F.col("d") < short).select("movie", "i", "j"), ["movie", "j"])
    anchors = points(nodes, "a").join(at.withColumnRenamed("i", "a"), ["movie", "a"])
    anchors = anchors.select("movie", "t", "a", *(f"{c}_a" for c in AXES), *((F.col(f"{c}_j") - F.col(f"{c}_a")).alias(f"m{c}") for c in AXES))
    asked = points(nodes, "i").join(nnd.withColumnRenamed("node_id", "i"), ["movie", "i"])
    reach, near, last = 3 * F.greatest("nnd", F.lit(4.0)), None, 0.0
    for width in (12.0, 24.0, widest):
        part = asked.where((reach > last) & (reach <= width))
        part = sp.radius_join(anchors, part, "a", "i", width).where((F.col("i") != F.col("a")) & (F.col("d") <= reach))
        near, last = part if near is None else near.unionByName(part), width
    med = near.groupBy("movie", "i").agg(F.count(F.lit(1)).alias("tis_n"), *(F.percentile(f"m{c}", F.lit(0.5)).alias(f"f{c}") for c in AXES))
    return med.where("tis_n >= 2")


def edge26(nodes: DataFrame, links: DataFrame, seed: str | None = None, size: str | None = None) -> DataFrame:
    """The 26 geometry columns of links (movie, i, j, d); seed and size are columns of ``nodes``, 1 and 0 if not given."""
    return _edge_rows(nodes, links, [], seed, size)


def _edge_rows(nodes: DataFrame, links: DataFrame, names: list[str], seed: str | None, size: str | None) -> DataFrame:
    """``edge26``, then the columns of ``evidence21`` of the evidences of ``links``: ranks and facts of each end by one exchange of the links."""
    stages = Stages(nodes.sparkSession, "edge26")
    nodes = nodes.select("movie", "node_id", "t", *(f"{c}_um" for c in AXES), (F.col(seed) if seed else F.lit(1.0)).alias("seed"), (F.col(size) if size else F.lit(0.0)).alias("size"))
    nnd, nnd_path = stages.write(sp.nearest_in_frame(nodes, CAP), "nnd")
    with scope():
        first, first_path = stages.write(mt.link_frames(nodes, 7.0, 5.0), "first")
    moved, _ = stages.write(flow(nodes, nnd, first), "flow")
    parents = first.groupBy("movie", F.col("j").alias("node_id")).agg(F.count(F.lit(1)).alias("k"), F.min("i").alias("parent"))
    before = points(nodes, "b", 0).select("movie", F.col("b").alias("parent"), *(f"{c}_b" for c in AXES))
    vel = parents.where("k = 1").join(before, ["movie", "parent"])
    kids = first.select("movie", F.col("i").alias("node_id"), F.lit(1).alias("fut")).distinct()
    rich = nodes.join(nnd, ["movie", "node_id"]).join(vel, ["movie", "node_id"], "left").join(kids, ["movie", "node_id"], "left").join(parents.select("movie", "node_id", F.lit(1).alias("past")), ["movie", "node_id"], "left")
    last = nodes.groupBy("movie").agg((F.max("t") + 1).alias("frames"))
    rich = rich.join(last, "movie")
    rich, _ = stages.write(rich.select("movie", "node_id", "t", *(F.col(f"{c}_um").alias(c) for c in AXES), "nnd", "seed", "size", F.col("k").isNotNull().cast("int").alias("known"), *((F.coalesce(F.col(f"{c}_um") - F.col(f"{c}_b"), F.lit(0.0))).alias(f"v{c}") for c in AXES), F.coalesce("fut", F.lit(0)).alias("fut"), F.coalesce("past", F.lit(0)).alias("past"), "frames"), "rich")
    stages.drop(nnd_path, first_path)
    a = rich.select("movie", F.col("node_id").alias("i"), *(F.col(c).alias(f"{c}_i") for c in (*AXES, "nnd", "seed", "size", "t", "frames", "known", "past", "vz", "vy", "vx")))
    b = rich.select("movie", F.col("node_id").alias("j"), *(F.col(c).alias(f"{c}_j") for c in (*AXES, "nnd", "seed", "size", "fut")))
    rows = links
    for key, other, end, facts in (("j", "i", "dst", b), ("i", "j", "src", a)):
        rows = _ranked(lk.end_ranks(rows, key, other), names, key, other, end).join(facts, ["movie", key], "left")
    rows = rows.where("nnd_i is not null and nnd_j is not null").join(moved, ["movie", "i"], "left")
    cap = lambda c: F.least(c, F.lit(CAP))
    gone = lambda p: [F.col(f"{c}_j") - (F.col(f"{c}_i") + F.col(f"{p}{c}" if p == "f" else f"{p}{c}_i")) for c in AXES]
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return rows.select(
        "movie", "i", "j", "d", *((F.col(f"{c}_j") - F.col(f"{c}_i")).alias(f"d{c}") for c in AXES), (F.col("d") / F.greatest("nnd_i", F.lit(1.0))).alias("d_nnd"),
        "nnd_i", "nnd_j", "seed_i", "seed_j", "size_i", "size_j", "rank_ij", "rank_ji", "ncand_i", "ncand_j", cap(F.col("d2_i")).alias("d2_i"), cap(F.col("d2_j")).alias("d2_j"),
        cap(norm(gone("v"))).alias("vel_res"), F.col("known_i").alias("vel_known_i"), cap(F.coalesce(norm(gone("f")), "d")).alias("tis_res"), F.coalesce("tis_n", F.lit(0)).alias("tis_n"), "fut_j", F.col("past_i"),
        ((F.col("rank_ij") == 0) & (F.col("rank_ji") == 0)).cast("int").alias("mutual"), F.col("z_i"), (F.col("t_i") / F.col("frames_i")).alias("t_frac"),
        *(_evidence_columns(names) if names else []),
    )


def _ranked(links: DataFrame, names: list[str], key: str, other: str, end: str) -> DataFrame:
    """Adds rank from 0 and gap to the best of each evidence by one end; one step an end, as windows of both in one step would exchange rows to and fro."""
    w = Window.partitionBy("movie", key)
    cols = []
    for n in names:
        cols += [(F.row_number().over(w.orderBy(F.desc(n), other)) - 1).alias(f"{n}_rank_{end}"), (F.max(n).over(w) - F.col(n)).alias(f"{n}_gap_{end}")]
    return links.select("*", *cols)


def _evidence_columns(names: list[str]) -> list:
    parts = ("", "_rank_src", "_gap_src", "_rank_dst", "_gap_dst")
    return [*(F.col(f"{n}{part}") for n in names for part in parts), F.abs(F.col(names[0]) - F.col(names[1])).alias("spread")]


def evidence21(links: DataFrame, names: list[str], keep: tuple[str, ...] = (), stages: Stages | None = None) -> DataFrame:
    """Of each evidence, null as 0: the value, rank from 0 and gap to the best by source and target; then |first - second|, and columns to keep.

    With ``stages`` the ranks by source are written, so that the exchanges by source and by target never lie on disk at one time.
    """
    out = links.select("movie", "i", "j", *keep, *(F.coalesce(n, F.lit(0.0).cast("float")).alias(n) for n in names))
    out = _ranked(out, names, "i", "j", "src")
    if stages:
        out, _ = stages.write(out, "src")
    out = _ranked(out, names, "j", "i", "dst")
    return out.select("movie", "i", "j", *_evidence_columns(names), *keep)


def link_pairs(links: DataFrame, best: int = 3) -> DataFrame:
    """Each mother with two of her best targets: p, ranks, best competing p into each target, best p and count out of it."""
    zero = F.lit(0.0).cast("float")
    ranked = links.withColumn("r", F.row_number().over(Window.partitionBy("movie", "i").orderBy(F.desc("p"), "j"))).where(F.col("r") <= best)
    side = lambda k: ranked.select("movie", F.col("i").alias("u"), F.col("j").alias(f"d{k}"), F.col("p").alias(f"p{k}"), F.col("r").alias(f"r{k}"))
    rows = side(1).join(side(2), ["movie", "u"]).where("r1 < r2")
    into = links.withColumn("r", F.row_number().over(Window.partitionBy("movie", "j").orderBy(F.desc("p"), "i"))).where("r <= 2")
    into = into.groupBy("movie", "j").agg(F.max(F.when(F.col("r") == 1, F.col("i"))).alias("who"), F.max(F.when(F.col("r") == 1, F.col("p"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("p"))).alias("two"))
    out = links.groupBy("movie", "i").agg(F.max("p").alias("out"), F.count(F.lit(1)).alias("n"))
    for k in (1, 2):
        rows = rows.join(into.select("movie", F.col("j").alias(f"d{k}"), "who", "one", "two"), ["movie", f"d{k}"], "left")
        rows = rows.withColumn(f"io{k}", F.coalesce(F.when(F.col("who") == F.col("u"), F.col("two")).otherwise(F.col("one")), zero)).drop("who", "one", "two")
        rows = rows.join(out.select("movie", F.col("i").alias(f"d{k}"), F.col("out").alias(f"out{k}"), F.col("n").alias(f"n{k}")), ["movie", f"d{k}"], "left")
        rows = rows.withColumn(f"out{k}", F.coalesce(f"out{k}", zero)).withColumn(f"n{k}", F.coalesce(f"n{k}", F.lit(0)))
    return rows.select("movie", "u", "d1", "d2", "p1", "p2", F.least("p1", "p2").alias("pmin"), (F.col("p1").cast("double") + F.col("p2").cast("double")).alias("psum"), "r1", "r2", F.greatest("r1", "r2").alias("rmax"), "io1", "io2", "out1", "out2", "n1", "n2")


def node_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Of each node its three best links, their ratio and margin, degrees, best link into it and the place of p2 in the frame."""
    top = lk.top_links(links).withColumnRenamed("i", "node_id")
    into = links.groupBy("movie", F.col("j").alias("node_id")).agg(F.max("p").alias("q1"), F.count(F.lit(1)).alias("n_in"))
    rows = nodes.select("movie", "node_id", "t").join(top, ["movie", "node_id"], "left").join(into, ["movie", "node_id"], "left")
    zero = F.lit(0.0).cast("float")
    rows = rows.select("movie", "node_id", "t", *(F.coalesce(F.col(f"p{k}").cast("float"), zero).alias(f"p{k}") for k in (1, 2, 3)), F.coalesce("degree", F.lit(0)).alias("n_out"), F.coalesce("q1", zero).alias("q1"), F.coalesce("n_in", F.lit(0)).alias("n_in"))
    p1, p2 = F.col("p1").cast("double"), F.col("p2").cast("double")
    rows = lk.percent_ranks(rows, ["movie", "t"], "p2", "node_id").withColumnRenamed("pct", "p2_pct")
    return rows.select("movie", "node_id", "t", "p1", "p2", "p3", safe_div(p2, p1).alias("p2_p1"), (p1 - p2).alias("margin"), "n_out", "q1", "n_in", "p2_pct")


def edge47(nodes: DataFrame, links: DataFrame, evidence: DataFrame, names: list[str], seed: str | None = None, size: str | None = None) -> DataFrame:
    """``edge26`` of the candidate links (movie, i, j, d) with ``evidence21`` of what is known of them, 47 columns for four evidences."""
    stages, none = Stages(nodes.sparkSession, "edge47"), F.lit(0.0).cast("float")
    known = links.select("movie", "i", "j", "d").join(evidence.select("movie", "i", "j", *names), ["movie", "i", "j"], "left")
    known, _ = stages.write(known.withColumns({n: F.coalesce(n, none) for n in names}), "known")
    return _edge_rows(nodes, known, names, seed, size)


def densities(nodes: DataFrame, near: float = 8.0, wide: float = 15.0) -> DataFrame:
    """(movie, node_id, own_near, own_wide, next_near, next_wide): other nodes of the frame and nodes of the next within two radii, by one
    join a frame; where there is no next frame its numbers are the own ones and one."""
    rows = nodes.select("movie", "t", "node_id")
    for name, shift in (("own", 0), ("next", 1)):
        pairs = sp.radius_join(points(nodes, "i"), points(nodes, "j", -shift), "i", "j", wide)
        pairs = pairs if shift else pairs.where("i <> j")
        n = pairs.groupBy("movie", F.col("i").alias("node_id")).agg(F.sum((F.col("d") <= near).cast("long")).alias(f"{name}_near"), F.count(F.lit(1)).alias(f"{name}_wide"))
        rows = rows.join(n, ["movie", "node_id"], "left").fillna(0, [f"{name}_near", f"{name}_wide"])
    frames = nodes.select("movie", (F.col("t") - 1).alias("t"), F.lit(True).alias("has_next")).distinct()
    then = lambda w: F.when(F.col("has_next"), F.col(f"next_{w}")).otherwise(F.col(f"own_{w}") + 1).alias(f"next_{w}")
    return rows.join(frames, ["movie", "t"], "left").select("movie", "node_id", "own_near", "own_wide", then("near"), then("wide"))


#: The node columns, by name and in order.
NODE53 = [
    "p1", "p2", "p3", "p2_over_p1", "p1_minus_p2", "p3_over_p2", "n_out", "q1", "n_in", "p2_rank", "d1", "d2", "dsib", "cos_sib", "dsib_over_d", "sym", "d1_rel", "d2_rel",
    "c1_q1", "c2_q1", "c1_is_mine", "c2_is_mine", "c1_nin", "c2_nin", "p2_margin_c2", "p1_margin_c1", "c1_out", "c2_out", "c1_nout", "c2_nout", "grand_div",
    "mot_in", "cos_turn1", "cos_turn2", "mot_in_rel", "dens15", "dens8", "dnext15", "dnext8", "ddens15", "ddens8", "cnn", "cnn_rank", "trel", "p2_x_cnn",
    "dsib2", "dsib_growth", "cos_sib2", "gc_min_p", "dsib13", "cos13", "dsib23", "cos23",
]


def node53(nodes: DataFrame, links: DataFrame, prior: DataFrame) -> DataFrame:
    """(movie, node_id, the 53 columns of NODE53) of every node.

    ``links`` (movie, i, j, p) have both ends among ``nodes``; ``prior`` is (movie, node_id, score), 0 where there is none.  A child or
    parent that is missing has p, counts and distances 0.  Equal p go to the smaller partner, equal places in a frame to the smaller node.
    All children are looked up in one join, three rows a node at most, and gathered again by the node.
    """
    stages = Stages(nodes.sparkSession, "node53")
    links, key, zero = links.select("movie", "i", "j", F.col("p").cast("double").alias("p")), ["movie", "node_id"], F.lit(0.0)
    top = lk.top_links(links).withColumnsRenamed({"i": "node_id", "degree": "n_out"})
    into = lk.top_links(links, "j", "i", 2).select("movie", F.col("j").alias("node_id"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("c1").alias("m1"), F.col("degree").alias("n_in"))
    base = nodes.select(*key, "t", *(F.col(f"{c}_um").alias(c) for c in AXES)).join(top, key, "left").join(into, key, "left")
    base, _ = stages.write(base.fillna(0.0, ["p1", "p2", "p3", "q1", "q2"]).fillna(0, ["n_out", "n_in"]).fillna(-1, ["c1", "c2", "c3", "m1"]), "base")

    def place(of: str, name: str) -> DataFrame:
        """(movie, node_id, places) of each node's partner in column ``of``, of nodes that have one."""
        at = base.select("movie", F.col("node_id").alias("_at"), *(F.col(c).alias(f"{name}{c}") for c in AXES))
        return base.where(F.col(of) >= 0).select(*key, F.col(of).alias("_at")).join(at, ["movie", "_at"]).drop("_at")

    facts = ["z", "y", "x", "q1", "q2", "m1", "n_in", "p1", "p2", "n_out", "gz", "gy", "gx"]
    child = base.join(place("c1", "g"), key, "left").select("movie", F.col("node_id").alias("c"), *facts)
    asked = base.select(*key, F.explode(F.expr("filter(array(struct(1 as k, c1 as c), struct(2 as k, c2 as c), struct(3 as k, c3 as c)), e -> e.c >= 0)")).alias("e")).select(*key, "e.*")
    kids = asked.join(child, ["movie", "c"]).groupBy(*key).agg(*(F.max(F.when(F.col("k") == k, F.col(f))).alias(f"k{k}_{f}") for k in (1, 2, 3) for f in facts))
    rows = base.join(kids, key, "left").join(place("m1", "b"), key, "left").join(densities(nodes), key).join(prior.select(*key, F.col("score").cast("double").alias("cnn")), key, "left").fillna(0.0, ["cnn"])

    def way(a: str, b: str) -> list:
        return [F.coalesce(F.col(f"{b}{c}") - F.col(f"{a}{c}"), zero) for c in AXES]

    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    to = {k: way("", f"k{k}_") for k in (1, 2, 3)}
    moved = way("b", "")
    rows = rows.withColumns({"mot_in": norm(moved), **{f"d{k}": norm(to[k]) for k in (1, 2, 3)}})
    rows, _ = stages.write(rows, "rows")
    motion = rows.where("m1 >= 0").groupBy("movie", "t").agg(F.percentile("mot_in", F.lit(0.5)).alias("typical"))
    last = rows.groupBy("movie").agg(F.max("t").alias("last"))
    rows = rows.join(motion, ["movie", "t"], "left").join(last, "movie").withColumn("typical", F.when(F.col("typical") > 1e-6, F.col("typical")).otherwise(1.0))
    for value, rank in (("p2", "p2_rank"), ("cnn", "cnn_rank")):
        rows = lk.percent_ranks(rows, ["movie", "t"], value, "node_id").withColumnRenamed("pct", rank)
    kid = lambda k, f: F.coalesce(f"k{k}_{f}", F.lit(0))
    both = lambda a, b: norm(way(a, b))
    onward = F.col("k1_gz").isNotNull() & F.col("k2_gz").isNotNull()
    ahead = {k: [F.when(onward, w).otherwise(zero) for w in way("", f"k{k}_g")] for k in (1, 2)}
    p, c = {k: F.col(f"p{k}") for k in (1, 2, 3)}, F.col
    cols = {
        "p2_over_p1": safe_div(p[2], p[1]), "p1_minus_p2": p[1] - p[2], "p3_over_p2": safe_div(p[3], p[2]), "dsib": both("k1_", "k2_"), "cos_sib": cosine(to[1], to[2]),
        "d1_rel": safe_div(c("d1"), c("typical")), "d2_rel": safe_div(c("d2"), c("typical")), "sym": safe_div(F.abs(c("d1") - c("d2")), c("d1") + c("d2")),
        "cos_turn1": cosine(moved, to[1]), "cos_turn2": cosine(moved, to[2]), "mot_in_rel": safe_div(c("mot_in"), c("typical")),
        "dens15": c("own_wide"), "dens8": c("own_near"), "dnext15": c("next_wide"), "dnext8": c("next_near"), "ddens15": c("next_wide") - c("own_wide"), "ddens8": c("next_near") - c("own_near"),
        "trel": c("t") / F.greatest(c("last"), F.lit(1)), "p2_x_cnn": p[2] * c("cnn"), "dsib2": F.when(onward, both("k1_g", "k2_g")).otherwise(zero), "cos_sib2": cosine(ahead[1], ahead[2]),
        "gc_min_p": F.least(kid(1, "p1"), kid(2, "p1")), "grand_div": (kid(1, "p2") > 0.44).cast("int") + (kid(2, "p2") > 0.44).cast("int"),
        "dsib13": both("k1_", "k3_"), "cos13": cosine(to[1], to[3]), "dsib23": both("k2_", "k3_"), "cos23": cosine(to[2], to[3]),
    }
    for k in (1, 2):
        mine = F.coalesce(c(f"k{k}_m1") == c("node_id"), F.lit(False))
        cols |= {f"c{k}_q1": kid(k, "q1"), f"c{k}_is_mine": mine.cast("int"), f"c{k}_nin": kid(k, "n_in"), f"c{k}_out": kid(k, "p1"), f"c{k}_nout": kid(k, "n_out")}
        cols[f"p{k}_margin_c{k}"] = p[k] - F.when(mine, kid(k, "q2")).otherwise(kid(k, "q1"))
    rows = rows.withColumns(cols)
    rows = rows.withColumns({"dsib_over_d": safe_div(c("dsib"), c("d1") + c("d2")), "dsib_growth": safe_div(c("dsib2"), c("dsib"))})
    return rows.select(*key, *NODE53)


def pair_links(pairs: DataFrame, links: DataFrame, harmonic: DataFrame, vectors: DataFrame) -> DataFrame:
    """The 22 link columns of mothers and two daughters (movie, u, d1, d2).

    ``links`` and ``harmonic`` are (movie, i, j, p), ``vectors`` (movie, node_id, v) with unit vectors.  A link that is missing has p 0 and
    rank 9, a node without a vector cosines of 0.
    """
    stages = Stages(pairs.sparkSession, "pair_links")
    links, zero = links.select("movie", "i", "j", F.col("p").cast("double").alias("p")), F.lit(0.0)
    ranked = links.withColumn("r", F.row_number().over(Window.partitionBy("movie", "i").orderBy(F.desc("p"), "j")))
    link = ranked.join(harmonic.select("movie", "i", "j", F.col("p").cast("double").alias("h")), ["movie", "i", "j"], "full")
    link, _ = stages.write(link, "link")
    into = lk.top_links(links, "j", "i", 2).select("movie", F.col("j").alias("node_id"), F.col("p1").alias("one"), F.col("p2").alias("two"), F.col("c1").alias("who"))
    out = links.groupBy("movie", F.col("i").alias("node_id")).agg(F.max("p").alias("out"), F.count(F.lit(1)).alias("n"))
    facts, _ = stages.write(into.join(out, ["movie", "node_id"], "full").join(vectors.select("movie", "node_id", "v"), ["movie", "node_id"], "full"), "facts")
    rows = pairs.select("movie", "u", "d1", "d2").join(facts.select("movie", F.col("node_id").alias("u"), F.col("v").alias("vu")), ["movie", "u"], "left")
    for k in (1, 2):
        rows = rows.join(link.select("movie", F.col("i").alias("u"), F.col("j").alias(f"d{k}"), F.col("p").alias(f"p{k}"), F.col("r").alias(f"r{k}"), F.col("h").alias(f"h{k}")), ["movie", "u", f"d{k}"], "left")
        rows = rows.join(facts.select("movie", F.col("node_id").alias(f"d{k}"), "who", "one", "two", F.col("out").alias(f"out{k}"), F.col("n").alias(f"n{k}"), F.col("v").alias(f"v{k}")), ["movie", f"d{k}"], "left")
        rows = rows.withColumn(f"io{k}", F.coalesce(F.when(F.col("who") == F.col("u"), F.col("two")).otherwise(F.col("one")), zero)).drop("who", "one", "two")
        rows = rows.fillna(0.0, [f"p{k}", f"h{k}", f"out{k}"]).fillna(0, [f"n{k}"]).fillna(9, [f"r{k}"])
    dot = lambda a, b: F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), zero)
    over = lambda k: F.col(f"p{k}") / F.greatest(f"io{k}", F.lit(1e-3))
    return rows.select(
        "movie", "u", "d1", "d2", "p1", "p2", F.least("p1", "p2").alias("pmin"), (F.col("p1") + F.col("p2")).alias("psum"), "r1", "r2", F.greatest("r1", "r2").alias("rmax"), "h1", "h2", "io1", "io2",
        over(1).alias("over1"), over(2).alias("over2"), "out1", "out2", "n1", "n2", dot("vu", "v1").alias("cos1"), dot("vu", "v2").alias("cos2"), dot("v1", "v2").alias("cos12"),
        F.col("d1").isNotNull().cast("int").alias("has1"), F.col("d2").isNotNull().cast("int").alias("has2"),
    )
