"""Queries of the tracking operators over the driver's tables, each with its SQL.

The SQL states each operator independently of the Spark plan: distances as plain frame
joins, chains as recursive queries, ranks as window functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import AXES, distance, points, safe_div
from trackweave.operators import features as ft
from trackweave.operators import links as lk
from trackweave.operators import matching as mt
from trackweave.operators import samples as sm
from trackweave.operators import scoring as sc_
from trackweave.operators import spatial as sp
from trackweave.operators import tracks as tr
from trackweave.plans.stages import Stages, scope
from trackweave.sources.files import parse_bands
from trackweave.sources.tables import SCALE_ZYX, current_rows, current_scores, known_nodes, located_nodes, table, valid_edges

#: Peaks the reference keeps of a movie's frame.
MOST_PEAKS = 40_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_NODES = """n AS (
  SELECT movie, node_id, t, z, y, x, z * 1.625 AS z_um, y * 0.40625 AS y_um, x * 0.40625 AS x_um FROM (
    SELECT *, row_number() OVER (PARTITION BY movie, node_id ORDER BY ingested_at DESC NULLS LAST, t DESC NULLS LAST,
      z DESC NULLS LAST, y DESC NULLS LAST, x DESC NULLS LAST) AS rn
    FROM track_nodes WHERE movie IS NOT NULL AND node_id IS NOT NULL)
  WHERE rn = 1 AND t IS NOT NULL AND z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL
    AND NOT isnan(z) AND NOT isnan(y) AND NOT isnan(x) AND z <> -1 AND y <> -1 AND x <> -1)"""
_EDGES = """e AS (
  SELECT movie, source_id, target_id, p FROM (
    SELECT *, row_number() OVER (PARTITION BY movie, source_id, target_id ORDER BY ingested_at DESC NULLS LAST, p DESC NULLS LAST) AS rn
    FROM (SELECT movie, source_id, target_id, CASE WHEN isnan(p) THEN NULL ELSE p END AS p, ingested_at FROM track_edges
          WHERE movie IS NOT NULL AND source_id IS NOT NULL AND target_id IS NOT NULL))
  WHERE rn = 1 AND (movie, source_id) IN (SELECT (movie, node_id) FROM track_nodes)
    AND (movie, target_id) IN (SELECT (movie, node_id) FROM track_nodes))"""
_SCORES = """s AS (
  SELECT movie, source, i, j, p FROM (
    SELECT *, row_number() OVER (PARTITION BY movie, source, i, j ORDER BY scored_at DESC NULLS LAST, p DESC NULLS LAST) AS rn
    FROM link_scores WHERE movie IS NOT NULL AND source IS NOT NULL AND i IS NOT NULL AND j IS NOT NULL AND i <> -1 AND j <> -1)
  WHERE rn = 1 AND p IS NOT NULL AND NOT isnan(p))"""
_LEARNED = _SCORES + ", l AS (SELECT movie, i, j, p FROM s WHERE source = 'learned')"
_FOREST = _EDGES + """, f AS (
  SELECT movie, source_id, target_id, p FROM (SELECT *, row_number() OVER (PARTITION BY movie, target_id ORDER BY p DESC NULLS LAST, source_id) AS r FROM e) WHERE r = 1)"""
_DIST = "sqrt((b.z_um - a.z_um) * (b.z_um - a.z_um) + (b.y_um - a.y_um) * (b.y_um - a.y_um) + (b.x_um - a.x_um) * (b.x_um - a.x_um))"
_NEXT = f"SELECT a.movie, a.node_id AS i, b.node_id AS j, {_DIST} AS d FROM n a JOIN n b ON a.movie = b.movie AND b.t = a.t + 1"
_SAME = f"SELECT a.movie, a.node_id AS i, b.node_id AS j, {_DIST} AS d FROM n a JOIN n b ON a.movie = b.movie AND b.t = a.t AND a.node_id <> b.node_id"
_LINKS = _NODES + f", c AS ({_NEXT}), k AS (SELECT * FROM c WHERE d <= 10)"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _nodes(spark, d):
    return located_nodes(table(spark, d, "track_nodes"))


def _edges(spark, d):
    return valid_edges(table(spark, d, "track_edges"), table(spark, d, "track_nodes"))


def _scores(spark, d, within=None, more=None):
    """Current links; rows of ``more`` (movie, source, i, j, scored_at, p) go along."""
    rows = table(spark, d, "link_scores").where("movie is not null and source is not null and i is not null and j is not null and i <> -1 and j <> -1")
    rows = rows.select("movie", "source", "i", "j", "scored_at", "p")
    cur = current_scores(rows if more is None else rows.unionByName(more), ["movie", "source", "i", "j"], "scored_at", "p", within)
    return cur.where(F.col("p").isNotNull() & ~F.isnan("p"))


def _learned(spark, d):
    return _scores(spark, d).where("source = 'learned'").select("movie", "i", "j", "p")


# --- projections and filters


@_query(f"WITH {_NODES} SELECT movie, node_id, z_um, y_um, x_um, round_even(z_um / 1.625, 0) AS z_vox, round_even(x_um / 0.40625, 0) AS x_vox FROM n")
def prj_um_vox(spark, d):
    """Voxels to um and back, rounded half to even."""
    return _nodes(spark, d).select("movie", "node_id", "z_um", "y_um", "x_um", F.rint(F.col("z_um") / SCALE_ZYX[0]).alias("z_vox"), F.rint(F.col("x_um") / SCALE_ZYX[2]).alias("x_vox"))


@_query("""SELECT event_type, event_id, CASE WHEN hi > lo THEN round(least(greatest((value - lo) / (hi - lo), -0.5), 6.0), 9) ELSE 0.0 END AS v
FROM events JOIN (SELECT event_type, quantile_cont(value, 0.5) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY 1) USING (event_type)""")
def prj_normalize_frame(spark, d):
    """(v - p50) / (p99.5 - p50), cut to [-0.5, 6]; 0 where the range is empty."""
    ev = table(spark, d, "events")
    q = ev.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.995))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    v = F.least(F.greatest((F.col("value") - lo) / F.when(hi > lo, hi - lo), F.lit(-0.5)), F.lit(6.0))
    return ev.join(q, "event_type").select("event_type", "event_id", F.when(hi > lo, F.round(v, 9)).otherwise(F.lit(0.0)).alias("v"))


@_query("""SELECT event_type, event_id, round(greatest((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 0), 9) AS v
FROM events JOIN (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.997) AS hi FROM events GROUP BY 1) USING (event_type)""")
def prj_robust_norm(spark, d):
    """(v - p1) / (p99.7 - p1), cut below at 0; the range counts as 1 where it is empty."""
    ev = table(spark, d, "events")
    q = ev.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.997))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return ev.join(q, "event_type").select("event_type", "event_id", F.round(F.greatest((F.col("value") - lo) / F.when(hi > lo, hi - lo).otherwise(1.0), F.lit(0.0)), 9).alias("v"))


@_query(f"WITH {_NODES} SELECT movie, t, CAST(floor(y / 4) AS BIGINT) AS gy, CAST(floor(x / 4) AS BIGINT) AS gx, round(avg(z), 6) AS mean_z, count(*) AS n FROM n GROUP BY ALL")
def prj_pool_xy(spark, d):
    """Mean over 4 x 4 cells of Y and X."""
    return _nodes(spark, d).groupBy("movie", "t", F.floor(F.col("y") / 4).alias("gy"), F.floor(F.col("x") / 4).alias("gx")).agg(F.round(F.avg("z"), 6).alias("mean_z"), F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_LEARNED} SELECT movie, i, j, p FROM l WHERE p >= CAST(0.02 AS FLOAT)")
def flt_pmin(spark, d):
    """Links with p >= 0.02."""
    return _learned(spark, d).where(F.col("p") >= F.lit(0.02).cast("float"))


@_query(f"""WITH {_NODES}, sp AS (SELECT movie, pow(110.5 * 208.0 * 208.0 / greatest(1, count(*) / greatest(1, max(t) + 1)), 1.0 / 3) AS spacing FROM n GROUP BY movie)
SELECT movie, round(spacing, 6) AS spacing, CASE WHEN spacing >= 19.7 AND spacing < 25 THEN 'or' WHEN spacing >= 25 AND spacing < 99 THEN 'and' END AS mode FROM sp""")
def flt_density_band(spark, d):
    """The first density band of each movie's spacing: 19.7 to 25 'or', 25 to 99 'and', else none."""
    s = F.col("spacing")
    return _spacing(spark, d).select("movie", F.round(s, 6).alias("spacing"), F.when((s >= 19.7) & (s < 25), "or").when((s >= 25) & (s < 99), "and").alias("mode"))


def _spacing(spark, d):
    n = _nodes(spark, d).groupBy("movie").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last"))
    per = F.greatest(F.lit(1.0), F.col("n") / F.greatest(F.lit(1), F.col("last") + 1))
    return n.select("movie", F.pow(F.lit(110.5 * 208.0 * 208.0) / per, F.lit(1.0 / 3)).alias("spacing"))


@_query(f"WITH {_NODES} SELECT movie, round(pow(110.5 * 208.0 * 208.0 / greatest(1, count(*) / greatest(1, max(t) + 1)), 1.0 / 3), 6) AS spacing FROM n GROUP BY movie")
def ag_spacing(spark, d):
    """Cube root of the volume of a movie per node of a mean frame."""
    return _spacing(spark, d).select("movie", F.round("spacing", 6).alias("spacing"))


@_query("SELECT movie, dog_sp, coalesce(dog_sp, 0) >= 19.7 AS is_sparse FROM route")
def flt_sparse_route(spark, d):
    """Sparse movies: spacing of at least 19.7; a missing spacing is 0."""
    return table(spark, d, "route").select("movie", "dog_sp", (F.coalesce("dog_sp", F.lit(0.0)) >= 19.7).alias("is_sparse"))


# --- equi joins

_PIVOT = "SELECT movie, i, j, max(p) FILTER (source = 'tf_fwd') AS tf_fwd, max(p) FILTER (source = 'tf_harm') AS tf_harm, max(p) FILTER (source = 'embed') AS embed, max(p) FILTER (source = 'learned') AS learned FROM s GROUP BY ALL"


def _evidences():
    return [F.max(F.when(F.col("source") == s, F.col("p"))).alias(s) for s in ("tf_fwd", "tf_harm", "embed", "learned")]


def _pivot(spark, d):
    return _scores(spark, d, ["movie", "i", "j"]).groupBy("movie", "i", "j").agg(*_evidences())


@_query(f"WITH {_SCORES} {_PIVOT}")
def jn_evidence_pivot(spark, d):
    """The evidence of each link as columns, joined by key."""
    return _pivot(spark, d)


@_query(f"WITH {_SCORES}, v AS ({_PIVOT}) SELECT movie, i, j, learned AS p, coalesce(tf_harm, 0) AS alt FROM v WHERE learned IS NOT NULL")
def jn_alt_prob(spark, d):
    """The learned p of each link with its harmonic one, 0 where there is none."""
    return _pivot(spark, d).where("learned is not null").select("movie", "i", "j", F.col("learned").alias("p"), F.coalesce("tf_harm", F.lit(0.0).cast("float")).alias("alt"))


@_query(f"WITH {_EDGES}, {_LEARNED} SELECT e.movie, source_id, target_id, coalesce(l.p, 0) AS p, coalesce(l.r, 9) AS rank FROM e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY p DESC, j) AS r FROM l) l ON e.movie = l.movie AND source_id = i AND target_id = j")
def jn_link_lookup(spark, d):
    """p and rank of the link of each edge; 0 and 9 where it has none."""
    l = _learned(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("movie", "i").orderBy(F.desc("p"), "j"))).withColumnsRenamed({"i": "source_id", "j": "target_id"})
    e = _edges(spark, d).select("movie", "source_id", "target_id")
    return e.join(l, ["movie", "source_id", "target_id"], "left").select("movie", "source_id", "target_id", F.coalesce("p", F.lit(0.0).cast("float")).alias("p"), F.coalesce("rank", F.lit(9)).alias("rank"))


SQL["wn_link_rank"] = SQL["jn_link_lookup"]
QUERIES["wn_link_rank"] = jn_link_lookup


@_query(f"WITH {_NODES}, {_EDGES} SELECT e.movie, source_id, target_id, a.t AS t_i, b.t AS t_j, {_DIST} AS d FROM e JOIN n a ON e.movie = a.movie AND source_id = a.node_id JOIN n b ON e.movie = b.movie AND target_id = b.node_id")
def jn_endpoint_attrs(spark, d):
    """Attributes of both ends of every edge."""
    n = _nodes(spark, d)
    a = points(n, "a").withColumnsRenamed({"t": "t_i", "a": "source_id"})
    b = points(n, "b").withColumnsRenamed({"t": "t_j", "b": "target_id"})
    return _edges(spark, d).join(a, ["movie", "source_id"]).join(b, ["movie", "target_id"]).select("movie", "source_id", "target_id", "t_i", "t_j", distance("_a", "_b").alias("d"))


@_query(f"WITH {_LEARNED}, b AS (SELECT movie, i, j, p FROM (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY p DESC, j) AS r FROM l) WHERE r = 1) SELECT b.movie, b.i, b.j AS child, coalesce(g.j, -1) AS grandchild FROM b LEFT JOIN b g ON b.movie = g.movie AND b.j = g.i")
def jn_top_child_chain(spark, d):
    """Best child and its best child."""
    b = lk.best_links(_learned(spark, d))
    g = b.select("movie", F.col("i").alias("child"), F.col("j").alias("g"))
    return b.select("movie", "i", F.col("j").alias("child")).join(g, ["movie", "child"], "left").select("movie", "i", "child", F.coalesce("g", F.lit(-1)).alias("grandchild"))


@_query(f"WITH {_SCORES} SELECT movie, i, j, round(avg(p), 6) AS p, count(*) AS k FROM s GROUP BY ALL HAVING count(*) >= 2")
def jn_score_mean(spark, d):
    """Mean of a link's evidences, where it has several."""
    return _scores(spark, d).groupBy("movie", "i", "j").agg(F.round(F.avg("p"), 6).alias("p"), F.count(F.lit(1)).alias("k")).where("k >= 2")


@_query(f"WITH {_SCORES}, v AS ({_PIVOT}) SELECT movie, i, j, greatest(coalesce(learned, 0), coalesce(embed, 0)) AS p FROM v")
def jn_max_combine(spark, d):
    """The larger of two evidences, a missing one as 0."""
    zero = F.lit(0.0).cast("float")
    return _pivot(spark, d).select("movie", "i", "j", F.greatest(F.coalesce("learned", zero), F.coalesce("embed", zero)).alias("p"))


@_query(f"""WITH {_EDGES}, {_LEARNED}, par AS (SELECT DISTINCT movie, source_id FROM e)
SELECT l.movie, i, j, CASE WHEN e.target_id IS NOT NULL THEN 1 WHEN par.source_id IS NOT NULL THEN 0 END AS y
FROM l LEFT JOIN e ON l.movie = e.movie AND i = e.source_id AND j = e.target_id LEFT JOIN par ON l.movie = par.movie AND i = par.source_id""")
def jn_gt_child(spark, d):
    """Label of a link: 1 where it is an edge, 0 where the source has other children, else none."""
    e = _edges(spark, d).select("movie", F.col("source_id").alias("i"), F.col("target_id").alias("j"), F.lit(True).alias("hit"))
    par = e.select("movie", "i", F.lit(True).alias("has")).distinct()
    return _learned(spark, d).join(e, ["movie", "i", "j"], "left").join(par, ["movie", "i"], "left").select("movie", "i", "j", F.when(F.col("hit"), 1).when(F.col("has"), 0).alias("y"))


@_query(f"WITH {_NODES}, {_EDGES}, c AS (SELECT movie, source_id, count(*) AS k FROM e GROUP BY ALL) SELECT n.movie, node_id, CASE WHEN k >= 2 THEN 1 WHEN k = 1 THEN 0 END AS y FROM n LEFT JOIN c ON n.movie = c.movie AND node_id = source_id")
def jn_gt_child_count(spark, d):
    """Label of a node: 1 with two or more children, 0 with one, else none."""
    c = _edges(spark, d).groupBy("movie", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("k"))
    return _nodes(spark, d).join(c, ["movie", "node_id"], "left").select("movie", "node_id", F.when(F.col("k") >= 2, 1).when(F.col("k") == 1, 0).alias("y"))


@_query(f"WITH {_NODES}, {_EDGES} SELECT movie, node_id FROM n WHERE (movie, node_id) NOT IN (SELECT (movie, source_id) FROM e) AND movie IN (SELECT movie FROM route WHERE movie IS NOT NULL)")
def jn_semi_anti(spark, d):
    """Nodes of routed movies that have no child."""
    out = _edges(spark, d).select("movie", F.col("source_id").alias("node_id"))
    return _nodes(spark, d).select("movie", "node_id").join(out, ["movie", "node_id"], "left_anti").join(table(spark, d, "route").select("movie"), "movie", "left_semi")


# --- distance joins


@_query(f"WITH {_LINKS} SELECT * FROM k")
def sj_radius_t1(spark, d):
    """Pairs of a frame and the next at most 10 um apart."""
    return sp.next_frame_pairs(_nodes(spark, d))


_KNN_OUT = "SELECT movie, i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY d, j) AS r FROM c) WHERE r <= 5"
_KNN_IN = "SELECT movie, i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY movie, j ORDER BY d, i) AS r FROM c) WHERE r <= 3"


@_query(f"WITH {_LINKS} {_KNN_OUT}")
def sj_knn_out(spark, d):
    """The five nearest nodes of the next frame."""
    return sp.next_frame_nearest(_nodes(spark, d), 5, "i")


@_query(f"WITH {_LINKS} {_KNN_IN}")
def sj_knn_in(spark, d):
    """The three nearest nodes of the frame before."""
    return sp.next_frame_nearest(_nodes(spark, d), 3, "j")


_CAND = f"{_LINKS}, q AS (SELECT * FROM k UNION {_KNN_OUT} UNION {_KNN_IN})"


@_query(f"WITH {_CAND} SELECT * FROM q")
def sj_candidates(spark, d):
    """Candidate links: in reach, nearest successors, nearest predecessors."""
    return sp.candidates(_nodes(spark, d))


@_query(f"WITH {_NODES}, w AS ({_SAME}) SELECT n.movie, node_id, least(coalesce(min(d), 15.0), 15.0) AS nnd FROM n LEFT JOIN w ON n.movie = w.movie AND node_id = i GROUP BY ALL")
def sj_nnd(spark, d):
    """Distance of the nearest node of the frame, at most 15."""
    return sp.nearest_in_frame(_nodes(spark, d))


@_query(f"WITH {_NODES}, w AS ({_SAME}) SELECT n.movie, node_id, count(i) AS n FROM n LEFT JOIN w ON n.movie = w.movie AND node_id = i AND d <= 15 GROUP BY ALL")
def sj_density_same(spark, d):
    """Other nodes of the frame within 15 um."""
    return sp.crowding(_nodes(spark, d), 15.0)


@_query(f"""WITH {_NODES}, w AS ({_SAME}), c AS ({_NEXT}), own AS (SELECT n.movie, node_id, n.t, count(i) AS own FROM n LEFT JOIN w ON n.movie = w.movie AND node_id = i AND d <= 15 GROUP BY ALL),
nx AS (SELECT movie, i, count(*) AS k FROM c WHERE d <= 15 GROUP BY ALL)
SELECT own.movie, node_id, CASE WHEN (own.movie, own.t + 1) IN (SELECT (movie, t) FROM n) THEN coalesce(k, 0) ELSE own + 1 END AS n FROM own LEFT JOIN nx ON own.movie = nx.movie AND node_id = i""")
def sj_density_next(spark, d):
    """Nodes of the next frame within 15 um; own density and one where there is no next frame."""
    return sp.crowding_next(_nodes(spark, d), 15.0)


@_query(f"""WITH {_NODES}, c AS ({_NEXT}) SELECT n.movie, node_id, coalesce(min_by(j, d * 1e6 + j * 1e-9), -1) AS nearest, min(d) AS d FROM n LEFT JOIN c ON n.movie = c.movie AND node_id = i AND d <= 5 GROUP BY ALL""")
def sj_nearest_cap(spark, d):
    """The nearest node of the next frame within 5 um, else -1."""
    return sp.nearest_with_cap(_nodes(spark, d), 1, 5.0)


@_query(f"WITH {_NODES} SELECT a.movie, a.node_id, EXISTS (SELECT 1 FROM n b JOIN {{ends}} r ON b.movie = r.movie AND b.node_id = r.node_id WHERE b.movie = a.movie AND b.t = a.t AND {_DIST} <= 6) AS supported FROM n a".replace("{ends}", "(SELECT DISTINCT movie, source_id AS node_id FROM track_edges)"))
def sj_support(spark, d):
    """Whether a node of the frame that is a recorded source lies within 6 um (a source supports itself)."""
    n = _nodes(spark, d)
    sources = table(spark, d, "track_edges").select("movie", F.col("source_id").alias("node_id")).distinct()
    return sp.supported(n, n.join(sources, ["movie", "node_id"], "left_semi"), 6.0)


@_query(f"WITH {_NODES}, r AS (SELECT n.* FROM n WHERE (movie, node_id) IN (SELECT (movie, target_id) FROM track_edges WHERE movie IS NOT NULL AND target_id IS NOT NULL)) SELECT a.movie, a.node_id FROM n a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.movie = a.movie AND b.t = a.t AND {_DIST} <= 4)")
def sj_pseudo_anti(spark, d):
    """Nodes without a recorded target of their frame within 4 um."""
    n = _nodes(spark, d)
    targets = table(spark, d, "track_edges").select("movie", F.col("target_id").alias("node_id"))
    return sp.unlabelled(n, n.join(targets, ["movie", "node_id"], "left_semi"))


@_query(f"""WITH {_NODES}, c AS (SELECT a.movie, a.node_id AS u, a.z_um AS zu, a.y_um AS yu, a.x_um AS xu, b.node_id AS j, b.z_um AS zj, b.y_um AS yj, b.x_um AS xj FROM n a JOIN n b ON a.movie = b.movie AND b.t = a.t + 1 WHERE {_DIST} <= 13.5),
q AS (SELECT a.movie, a.u, a.j AS d1, b.j AS d2, ((a.zj - a.zu) * (b.zj - b.zu) + (a.yj - a.yu) * (b.yj - b.yu) + (a.xj - a.xu) * (b.xj - b.xu))
 / greatest(sqrt((a.zj - a.zu) * (a.zj - a.zu) + (a.yj - a.yu) * (a.yj - a.yu) + (a.xj - a.xu) * (a.xj - a.xu)) * sqrt((b.zj - b.zu) * (b.zj - b.zu) + (b.yj - b.yu) * (b.yj - b.yu) + (b.xj - b.xu) * (b.xj - b.xu)), CAST(1e-6 AS DOUBLE)) AS cos, sqrt((b.zj - a.zj) * (b.zj - a.zj) + (b.yj - a.yj) * (b.yj - a.yj) + (b.xj - a.xj) * (b.xj - a.xj)) AS sis,
 (a.zj + b.zj) / 2 - a.zu AS mz, (a.yj + b.yj) / 2 - a.yu AS my, (a.xj + b.xj) / 2 - a.xu AS mx FROM c a JOIN c b ON a.movie = b.movie AND a.u = b.u AND a.j < b.j),
g AS (SELECT movie, u, d1, d2, sis, cos, sqrt(mz * mz + my * my + mx * mx) AS mid FROM q), h AS (SELECT *, mid + CAST(0.3 AS DOUBLE) * abs(sis - 8.0) AS score FROM g WHERE sis >= 4.5 AND sis <= 17 AND mid <= 7 AND cos <= CAST(0.6 AS DOUBLE))
SELECT movie, u, d1, d2, sis, mid, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY movie, u ORDER BY score, d1, d2) AS r FROM h) WHERE r <= 8""")
def sj_pair_triplets(spark, d):
    """For each mother the eight best pairs of possible daughters."""
    return sp.daughter_pairs(_nodes(spark, d)).withColumn("score", F.round("score", 9))


SQL["so_topk_pairs"] = SQL["flt_pair_gate"] = SQL["sj_pair_triplets"]
QUERIES["so_topk_pairs"] = QUERIES["flt_pair_gate"] = sj_pair_triplets


@_query(f"WITH {_NODES}, m AS (SELECT movie, max(t) AS last FROM n GROUP BY movie), f AS (SELECT DISTINCT movie, t FROM n) SELECT f.movie, t, k, least(greatest(t + k, 0), last) AS at FROM f JOIN m USING (movie), (VALUES (-2), (-1), (0), (1), (2)) w(k)")
def tj_window_clamped(spark, d):
    """The frames around each frame, clamped to the movie."""
    return sp.clamped_window(_nodes(spark, d), 2)


# --- ranks and gaps of links


@_query(f"""WITH {_LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY d, j) - 1 AS rank_ij, row_number() OVER (PARTITION BY movie, j ORDER BY d, i) - 1 AS rank_ji FROM k)
SELECT movie, i, j, d, rank_ij, rank_ji, count(*) OVER (PARTITION BY movie, i) AS ncand_i, count(*) OVER (PARTITION BY movie, j) AS ncand_j,
coalesce(min(CASE WHEN rank_ij = 1 THEN d END) OVER (PARTITION BY movie, i), 15.0) AS d2_i, coalesce(min(CASE WHEN rank_ji = 1 THEN d END) OVER (PARTITION BY movie, j), 15.0) AS d2_j FROM r""")
def wn_rank_src(spark, d):
    """Ranks by distance, candidate counts and second distances of both ends."""
    return lk.distance_ranks(sp.next_frame_pairs(_nodes(spark, d)))


SQL["wn_rank_dst"], QUERIES["wn_rank_dst"] = SQL["wn_rank_src"], wn_rank_src


@_query(f"""WITH {_LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY d, j) AS a, row_number() OVER (PARTITION BY movie, j ORDER BY d, i) AS b FROM k) SELECT movie, i, j, d FROM r WHERE a = 1 AND b = 1""")
def mt_mutual_best(spark, d):
    """Links that are the nearest of both ends."""
    return lk.mutual_best(sp.next_frame_pairs(_nodes(spark, d)))


@_query(f"""WITH {_LEARNED} SELECT movie, i, j, p, row_number() OVER (PARTITION BY movie, i ORDER BY p DESC, j) - 1 AS rank_src, max(p) OVER (PARTITION BY movie, i) - p AS gap_src,
row_number() OVER (PARTITION BY movie, j ORDER BY p DESC, i) - 1 AS rank_dst, max(p) OVER (PARTITION BY movie, j) - p AS gap_dst FROM l""")
def wn_extra_cols(spark, d):
    """Rank and gap to the best of one evidence, by source and by target."""
    return lk.evidence_columns(_learned(spark, d), "p")


@_query(f"""WITH {_LEARNED}, r AS (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY p DESC, j) AS r FROM l)
SELECT movie, i, coalesce(max(p) FILTER (r = 1), 0) AS p1, coalesce(max(p) FILTER (r = 2), 0) AS p2, coalesce(max(p) FILTER (r = 3), 0) AS p3,
coalesce(max(j) FILTER (r = 1), -1) AS c1, coalesce(max(j) FILTER (r = 2), -1) AS c2, coalesce(max(j) FILTER (r = 3), -1) AS c3, count(*) AS degree FROM r GROUP BY ALL""")
def wn_topk_edges(spark, d):
    """The three best links of a source as columns, padded with 0 and -1."""
    top = lk.top_links(_learned(spark, d))
    return top.select("movie", "i", *(F.col(f"p{k}").cast("float").alias(f"p{k}") for k in (1, 2, 3)), "c1", "c2", "c3", "degree")


@_query(f"WITH {_LEARNED} SELECT movie, i, j, p FROM (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY p DESC, j) AS r FROM l) WHERE r = 1")
def wn_top_row(spark, d):
    """The best link of every source."""
    return lk.best_links(_learned(spark, d))


@_query(f"""WITH {_NODES}, k AS ({_NEXT}), g AS (SELECT *, exp(-d / 2 - max(-d / 2) OVER (PARTITION BY movie, j)) AS ej, exp(-d / 2 - max(-d / 2) OVER (PARTITION BY movie, i)) AS ei FROM k),
h AS (SELECT movie, i, j, d, ej / sum(ej) OVER (PARTITION BY movie, j) AS fwd, ei / sum(ei) OVER (PARTITION BY movie, i) AS rev FROM g),
u AS (SELECT *, 1 / (0.85 / greatest(fwd, 1e-8) + 0.15 / greatest(rev, 1e-8)) AS m FROM h), v AS (SELECT *, m / sum(m) OVER (PARTITION BY movie, j) AS share FROM u)
SELECT movie, i, j, round(fwd, 6) AS fwd, round(rev, 6) AS rev, round(share, 6) AS harm FROM v WHERE d <= 10""")
def wn_softmax_group(spark, d):
    """Softmax of -d/2 over all sources of a target in the frame before and over all targets of a source in the next, and their harmonic
    mean, of the links of up to 10 um.  Pairs beyond 200 um have a share under e**-95 of such a link's and are not formed."""
    pairs = sp.next_frame_pairs(_nodes(spark, d), 200.0).withColumn("l", -F.col("d") / 2)
    out = lk.two_way_probabilities(pairs, "l", keep=("d",)).where("d <= 10")
    return out.select("movie", "i", "j", *(F.round(c, 6).alias(c) for c in ("fwd", "rev", "harm")))


SQL["wn_harmonic"], QUERIES["wn_harmonic"] = SQL["wn_softmax_group"], wn_softmax_group


@_query(f"WITH {_NODES} SELECT movie, t, node_id, (row_number() OVER (PARTITION BY movie, t ORDER BY z_um, node_id) - 1) / greatest(count(*) OVER (PARTITION BY movie, t) - 1, 1) AS pct FROM n")
def wn_pct_rank_frame(spark, d):
    """Place in the frame by depth, from 0 to 1, ties by id."""
    return lk.percent_ranks(_nodes(spark, d), ["movie", "t"], "z_um", "node_id").select("movie", "t", "node_id", "pct")


@_query(f"""WITH {_EDGES}, {_SCORES}, v AS ({_PIVOT}), k AS (SELECT movie, source_id AS i, count(*) AS c FROM e GROUP BY ALL), b AS (
 SELECT v.movie, v.i, v.j, learned AS p, coalesce(tf_harm, 0) AS alt, CASE WHEN c >= 2 THEN CAST(0.4 AS DOUBLE) ELSE 0 END AS s, row_number() OVER (PARTITION BY v.movie, v.i ORDER BY learned DESC, v.j) AS r
 FROM v LEFT JOIN k ON v.movie = k.movie AND v.i = k.i WHERE learned IS NOT NULL), u AS (SELECT *, CASE WHEN r > 1 AND s >= 0.2 THEN greatest(p, alt) ELSE p END AS used FROM b)
SELECT movie, i, j, p, used FROM u WHERE CAST(used AS DOUBLE) > greatest(CAST(0.3 AS DOUBLE) - CAST(0.5 AS DOUBLE) * s, 0)""")
def gr_alt_rescue(spark, d):
    """Links over the threshold of their source, second links of likely mothers counted with the better of two evidences."""
    prior = _edges(spark, d).groupBy("movie", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("movie", "node_id", F.lit(0.4).alias("score"))
    return lk.rescued(jn_alt_prob(spark, d), prior)


SQL["flt_eff_threshold"], QUERIES["flt_eff_threshold"] = SQL["gr_alt_rescue"], gr_alt_rescue


# --- aggregates


@_query(f"""WITH {_NODES}, w AS ({_SAME}), nn AS (SELECT w.movie, n.t, i, min(d) AS d FROM w JOIN n ON w.movie = n.movie AND i = node_id WHERE n.t % 5 = 0 GROUP BY ALL),
c AS (SELECT movie, t, median(d) AS m FROM nn GROUP BY ALL HAVING count(*) >= 5), o AS (SELECT DISTINCT movie FROM n)
SELECT o.movie, median(m) AS spacing, CASE WHEN median(m) >= 10 THEN 7 ELSE 4 END AS radius FROM o LEFT JOIN c ON o.movie = c.movie GROUP BY o.movie""")
def ag_median_nn(spark, d):
    """Median over every fifth frame of the median distance to the nearest node; the suppression radius it asks for.  A movie without
    frames of five nodes has no spacing and counts as dense."""
    all_ = _nodes(spark, d)
    n = all_.where("t % 5 = 0")
    near = sp.nearest_distance(n).join(n, ["movie", "node_id"])
    sizes = n.groupBy("movie", "t").agg(F.count(F.lit(1)).alias("k")).where("k >= 5")
    med = near.join(sizes, ["movie", "t"], "left_semi").groupBy("movie", "t").agg(F.percentile("nnd", F.lit(0.5)).alias("m"))
    out = all_.select("movie").distinct().join(med.groupBy("movie").agg(F.percentile("m", F.lit(0.5)).alias("spacing")), "movie", "left")
    return out.select("movie", "spacing", F.when(F.col("spacing") >= 10, 7).otherwise(4).alias("radius"))


@_query(f"WITH {_NODES} SELECT movie, t, round_even(z_um / 5, 0) AS cz, round_even(y_um / 5, 0) AS cy, round_even(x_um / 5, 0) AS cx, count(*) AS n, round(avg(z_um), 6) AS mz, max(y_um) AS top FROM n GROUP BY ALL")
def ag_cluster(spark, d):
    """Points gathered in rounded cells: count, mean place, largest value."""
    cell = [F.rint(F.col(f"{c}_um") / 5).alias(f"c{c}") for c in AXES]
    return _nodes(spark, d).groupBy("movie", "t", *cell).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("z_um"), 6).alias("mz"), F.max("y_um").alias("top"))


_MOVES = f"{_NODES}, {_EDGES}, m AS (SELECT e.movie, source_id, target_id, b.t, p, b.z_um - a.z_um AS dz, b.y_um - a.y_um AS dy, b.x_um - a.x_um AS dx FROM e JOIN n a ON e.movie = a.movie AND source_id = a.node_id JOIN n b ON e.movie = b.movie AND target_id = b.node_id AND b.t = a.t + 1)"
_VELOCITY = _MOVES + """, o AS (SELECT movie, source_id FROM e GROUP BY ALL HAVING count(*) = 1),
w AS (SELECT m.movie, t, count(*) AS k, median(dz) AS z, median(dy) AS y, median(dx) AS x FROM m JOIN o ON m.movie = o.movie AND m.source_id = o.source_id WHERE p > 0.5 GROUP BY ALL),
f AS (SELECT movie, unnest(range(0, max(t) + 1))::INT AS t FROM n GROUP BY movie),
v AS (SELECT f.movie, f.t, CASE WHEN k >= 8 THEN z ELSE 0 END AS vz, CASE WHEN k >= 8 THEN y ELSE 0 END AS vy, CASE WHEN k >= 8 THEN x ELSE 0 END AS vx FROM f LEFT JOIN w ON f.movie = w.movie AND f.t = w.t)"""


@_query(f"WITH {_VELOCITY} SELECT * FROM v")
def ag_frame_velocity(spark, d):
    """Median displacement of the sure single edges into each frame; 0 with fewer than eight."""
    return tr.frame_velocity(_nodes(spark, d), _edges(spark, d))


@_query(f"WITH {_VELOCITY} SELECT movie, t, round(sum(vz) OVER w, 6) AS sz, round(sum(vy) OVER w, 6) AS sy, round(sum(vx) OVER w, 6) AS sx FROM v WINDOW w AS (PARTITION BY movie ORDER BY t)")
def wn_cumsum_shift(spark, d):
    """Running drift of each movie."""
    s = tr.drift(tr.frame_velocity(_nodes(spark, d), _edges(spark, d)))
    return s.select("movie", "t", *(F.round(c, 6).alias(c) for c in ("sz", "sy", "sx")))


@_query(f"WITH {_MOVES} SELECT movie, t, CASE WHEN median(sqrt(dz * dz + dy * dy + dx * dx)) <= 1e-6 THEN 1.0 ELSE median(sqrt(dz * dz + dy * dy + dx * dx)) END AS motion FROM m GROUP BY ALL")
def ag_frame_median_motion(spark, d):
    """Median length of the motions into each frame, 1 where it is (nearly) 0."""
    m = tr.motions(_nodes(spark, d), _edges(spark, d)).withColumn("d", F.sqrt(F.col("dz") * F.col("dz") + F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")))
    med = m.groupBy("movie", "t").agg(F.percentile("d", F.lit(0.5)).alias("motion"))
    return med.select("movie", "t", F.when(F.col("motion") <= 1e-6, 1.0).otherwise(F.col("motion")).alias("motion"))


@_query(f"WITH {_NODES}, {_EDGES}, o AS (SELECT movie, source_id, count(*) AS k FROM e GROUP BY ALL), q AS (SELECT movie, target_id, count(*) AS k FROM e GROUP BY ALL) SELECT n.movie, node_id, coalesce(o.k, 0) AS out_deg, coalesce(q.k, 0) AS in_deg FROM n LEFT JOIN o ON n.movie = o.movie AND node_id = source_id LEFT JOIN q ON n.movie = q.movie AND node_id = target_id")
def ag_degree(spark, d):
    """Edges out of and into every node."""
    return tr.degrees(_nodes(spark, d), _edges(spark, d))


@_query("SELECT event_type, round(quantile_cont(value, 0.0), 9) AS q0, round(quantile_cont(value, 0.001), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS q2, round(quantile_cont(value, 0.999), 9) AS q3, round(quantile_cont(value, 1.0), 9) AS q4 FROM events GROUP BY event_type")
def ag_sampled_quantiles(spark, d):
    """Exact interpolated quantiles of each group, of all values."""
    q = F.percentile("value", F.array(*map(F.lit, (0.0, 0.001, 0.5, 0.999, 1.0))))
    return table(spark, d, "events").groupBy("event_type").agg(q.alias("q")).select("event_type", *(F.round(F.col("q")[k], 9).alias(f"q{k}") for k in range(5)))


# --- graphs

def _comp_sql(edges: str) -> str:
    """Founder of each node over edges(movie, source_id, target_id) with at most one parent a node, and how many nodes lie above it; -1 where
    the walk up meets no node without a parent, as it comes back to nodes already met."""
    return f"""up AS (SELECT movie, target_id AS node_id, source_id AS anc FROM ({edges}) UNION
  SELECT up.movie, up.node_id, g.source_id FROM up JOIN ({edges}) g ON up.movie = g.movie AND up.anc = g.target_id),
top AS (SELECT up.movie, up.node_id, coalesce(max(CASE WHEN g.target_id IS NULL THEN anc END), -1) AS root, count(*) AS k
  FROM up LEFT JOIN ({edges}) g ON up.movie = g.movie AND up.anc = g.target_id GROUP BY ALL)"""


def _recursive(ctes: str, edges: str) -> str:
    """Chains by their first node; nodes of chains without one, which are cycles, by themselves."""
    return f"WITH RECURSIVE {ctes}, {_comp_sql(edges)}, cc AS (SELECT n.movie, n.node_id, coalesce(nullif(root, -1), n.node_id) AS comp FROM n LEFT JOIN top ON n.movie = top.movie AND n.node_id = top.node_id)"


#: The smallest node that edges in whatever direction link each node with: all pairs of linked nodes by recursion.
_LINKED = f"""WITH RECURSIVE {_NODES}, {_EDGES},
u AS (SELECT movie, source_id AS a, target_id AS b FROM e WHERE source_id <> target_id UNION SELECT movie, target_id, source_id FROM e WHERE source_id <> target_id),
r AS (SELECT DISTINCT movie, a AS node_id, a AS other FROM u UNION SELECT r.movie, u.b, r.other FROM r JOIN u ON r.movie = u.movie AND r.node_id = u.a),
gg AS (SELECT movie, node_id, min(other) AS comp FROM r GROUP BY ALL),
cc AS (SELECT n.movie, n.node_id, coalesce(comp, n.node_id) AS comp FROM n LEFT JOIN gg ON n.movie = gg.movie AND n.node_id = gg.node_id)"""


@_query(_LINKED + " SELECT movie, node_id, comp, count(*) OVER (PARTITION BY movie, comp) AS n FROM cc")
def gr_components(spark, d):
    """Component of every node over all edges by its smallest node, and the component's size."""
    return tr.components(_nodes(spark, d), _edges(spark, d))


@_query(_LINKED + """, sz AS (SELECT movie, comp, count(*) AS k FROM cc GROUP BY ALL),
fk AS (SELECT DISTINCT cc.movie, comp FROM cc WHERE (movie, node_id) IN (SELECT (movie, source_id) FROM e GROUP BY movie, source_id HAVING count(*) >= 2))
SELECT cc.movie, node_id, cc.comp FROM cc JOIN sz ON cc.movie = sz.movie AND cc.comp = sz.comp WHERE k >= 3 OR (cc.movie, cc.comp) IN (SELECT (movie, comp) FROM fk)""")
def gr_filter_short(spark, d):
    """Components of at least three nodes or with a division."""
    return tr.long_tracks(_nodes(spark, d), _edges(spark, d), 3)


_CHAIN = "SELECT * FROM e WHERE (movie, source_id) IN (SELECT (movie, source_id) FROM e GROUP BY movie, source_id HAVING count(*) = 1) AND (movie, target_id) IN (SELECT (movie, target_id) FROM e GROUP BY movie, target_id HAVING count(*) = 1)"


@_query(_recursive(f"{_NODES}, {_EDGES}, ch AS ({_CHAIN})", "SELECT * FROM ch") + " SELECT movie, node_id, comp AS segment FROM cc")
def gr_segments(spark, d):
    """Maximal chains without forks and merges, by their first node; each node of a cyclic one by itself."""
    return tr.segments(_nodes(spark, d), _edges(spark, d))


@_query(_recursive(f"{_NODES}, {_EDGES}, ch AS ({_CHAIN})", "SELECT * FROM ch") + f""", r AS (SELECT n.* FROM n WHERE (movie, node_id) IN (SELECT (movie, target_id) FROM e)), su AS (SELECT a.movie, a.node_id,
 EXISTS (SELECT 1 FROM r b WHERE b.movie = a.movie AND b.t = a.t AND {_DIST} <= 4) AS s FROM n a)
SELECT cc.movie, comp AS segment, count(*) AS n, round(avg(s::INT), 6) AS share FROM cc JOIN su ON cc.movie = su.movie AND cc.node_id = su.node_id GROUP BY ALL HAVING avg(s::INT) < 0.4""")
def ag_segment_support(spark, d):
    """Segments less than two fifths of whose nodes are supported."""
    n, e = _nodes(spark, d), _edges(spark, d)
    ref = n.join(e.select("movie", F.col("target_id").alias("node_id")), ["movie", "node_id"], "left_semi")
    return tr.weak_segments(n, e, sp.supported(n, ref, 4.0), 0.4).withColumn("share", F.round("share", 6))


#: The density bands of the track gate, as lo:hi:mode:theta:r:r2.
GATE_BANDS = "19.7:25:or:0.4:4:5;25:99:and:0.2:5:5"


@_query(_recursive(f"{_NODES}, {_EDGES}, ch AS ({_CHAIN})", "SELECT * FROM ch") + f""",
bd AS (SELECT movie, CASE WHEN sp >= 19.7 AND sp < 25 THEN 1 WHEN sp >= 25 AND sp < 99 THEN 2 END AS b FROM (SELECT movie, coalesce(max(dog_sp), 0) AS sp FROM route GROUP BY movie)),
sv AS (SELECT a.movie, a.node_id, min({_DIST}) AS m FROM n a JOIN n b ON a.movie = b.movie AND a.t = b.t WHERE (b.movie, b.node_id) IN (SELECT (movie, target_id) FROM e) GROUP BY ALL),
sd AS (SELECT a.movie, a.node_id, min({_DIST}) AS m FROM n a JOIN n b ON a.movie = b.movie AND a.t = b.t WHERE (b.movie, b.node_id) IN (SELECT (movie, source_id) FROM e) GROUP BY ALL),
su AS (SELECT cc.movie, cc.node_id, comp, b, CASE WHEN b = 1 THEN coalesce(sd.m <= 4, false) OR coalesce(sv.m <= 5, false) ELSE coalesce(sd.m <= 5, false) AND coalesce(sv.m <= 5, false) END AS s
 FROM cc JOIN bd ON cc.movie = bd.movie LEFT JOIN sv ON cc.movie = sv.movie AND cc.node_id = sv.node_id LEFT JOIN sd ON cc.movie = sd.movie AND cc.node_id = sd.node_id WHERE b IS NOT NULL),
wk AS (SELECT movie, comp FROM su GROUP BY movie, comp HAVING avg(s::INT) < CASE WHEN max(b) = 1 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END),
go AS (SELECT su.movie, su.node_id FROM su JOIN wk ON su.movie = wk.movie AND su.comp = wk.comp)
SELECT n.movie AS dataset, 'node' AS row_type, node_id, t, CAST(round_even(z, 0) AS INT) AS z, CAST(round_even(y, 0) AS INT) AS y, CAST(round_even(x, 0) AS INT) AS x, -1 AS source_id, -1 AS target_id FROM n WHERE (movie, node_id) NOT IN (SELECT (movie, node_id) FROM go)
UNION ALL SELECT movie, 'edge', -1, -1, -1, -1, -1, source_id, target_id FROM e WHERE (movie, source_id) NOT IN (SELECT (movie, node_id) FROM go) AND (movie, target_id) NOT IN (SELECT (movie, node_id) FROM go)""")
def gr_track_gate(spark, d):
    """The result without segments that are badly supported in the density band of their movie's route.

    Recorded targets stand for the second model's points, recorded sources for the sensitive detector's.
    """
    stages = Stages(spark, "gate")
    n, e = stages.write(_nodes(spark, d), "nodes")[0], stages.write(_edges(spark, d), "edges")[0]
    among = lambda c: n.join(e.select("movie", F.col(c).alias("node_id")), ["movie", "node_id"], "left_semi")
    spacing = table(spark, d, "route").select("movie", F.col("dog_sp").alias("spacing"))
    return _rows(*tr.track_gate(n, e, spacing, among("target_id"), among("source_id"), parse_bands(GATE_BANDS)))


@_query(f"""WITH {_EDGES}, q AS (SELECT movie, source_id AS u, target_id, p, row_number() OVER (PARTITION BY movie, source_id ORDER BY p DESC NULLS LAST, target_id) AS r, count(*) OVER (PARTITION BY movie, source_id) AS k FROM e)
SELECT movie, u, max(target_id) FILTER (r = 1) AS d1, max(target_id) FILTER (r = 2) AS d2, max(p) FILTER (r = 1) AS p1, max(p) FILTER (r = 2) AS p2 FROM q WHERE k = 2 GROUP BY ALL""")
def gr_forks(spark, d):
    """Nodes with exactly two children, the more probable first."""
    return tr.forks(_edges(spark, d))


SQL["so_fork_order"], QUERIES["so_fork_order"] = SQL["gr_forks"], gr_forks


@_query(f"WITH {_NODES}, {_EDGES} SELECT movie, node_id FROM n WHERE (movie, node_id) IN (SELECT (movie, source_id) FROM e UNION SELECT (movie, target_id) FROM e) OR movie NOT IN (SELECT movie FROM e)")
def gr_prune_isolated(spark, d):
    """Nodes that are an end of an edge."""
    return tr.with_edges(_nodes(spark, d), _edges(spark, d)).select("movie", "node_id")


_GAPS = f"""{_NODES}, {_EDGES}, m AS (SELECT movie, max(t) AS last FROM n GROUP BY movie),
en AS (SELECT n.* FROM n JOIN m USING (movie) WHERE t <= last - 2 AND (movie, node_id) NOT IN (SELECT (movie, source_id) FROM e)),
st AS (SELECT n.* FROM n WHERE t >= 2 AND (movie, node_id) NOT IN (SELECT (movie, target_id) FROM e)),
gp AS (SELECT a.movie, a.node_id AS e, b.node_id AS s, b.t - a.t - 1 AS gap, {_DIST} AS d, a.t AS t0, a.z_um AS za, a.y_um AS ya, a.x_um AS xa, b.z_um AS zb, b.y_um AS yb, b.x_um AS xb
 FROM en a JOIN st b ON a.movie = b.movie AND b.t IN (a.t + 2, a.t + 3) WHERE {_DIST} <= 4 * (b.t - a.t)),
pt AS (SELECT movie, e, s, gap, t0 + k AS t, za + (zb - za) * k / (gap + 1) AS z_um, ya + (yb - ya) * k / (gap + 1) AS y_um, xa + (xb - xa) * k / (gap + 1) AS x_um FROM gp, (VALUES (1), (2)) w(k) WHERE k <= gap),
bad AS (SELECT DISTINCT b.movie, e, s, gap FROM pt b JOIN n a ON a.movie = b.movie AND a.t = b.t WHERE {_DIST} <= 2.5)"""


@_query(f"WITH {_GAPS} SELECT movie, e, s, gap, d FROM gp WHERE (movie, e, s, gap) NOT IN (SELECT (movie, e, s, gap) FROM bad)")
def tj_gap(spark, d):
    """Ends and starts of tracks that a gap of one or two frames may join, no node being in the way."""
    return tr.gap_pairs(_nodes(spark, d), _edges(spark, d)).withColumn("gap", F.col("gap").cast("int"))


SQL["sj_exclusion"], QUERIES["sj_exclusion"] = SQL["tj_gap"], tj_gap


@_query()
def mt_greedy_sorted(spark, d):
    """Bridges over gaps, shorter gaps and shorter distances first, each end and start once."""
    return tr.bridges(tr.gap_pairs(_nodes(spark, d), _edges(spark, d)))


def _with_bridges(spark, d, n, e, bridges, order):
    """The result with the interpolated nodes and edges of bridges; new ids follow the last id of any row of the movie."""
    last = known_nodes(table(spark, d, "track_nodes")).groupBy("movie").agg(F.max("node_id").alias("last_id"))
    new, links = tr.filled(n, bridges, last, order)
    new = new.select("movie", "node_id", "t", *((F.col(f"{c}_um") / F.lit(s)).alias(c) for c, s in zip(AXES, SCALE_ZYX)))
    return _rows(n.select("movie", "node_id", "t", *AXES).unionByName(new), e.select("movie", "source_id", "target_id").unionByName(links))


@_query()
def gr_gapfill(spark, d):
    """The result with short gaps bridged greedily: interpolated nodes with new ids and their edges."""
    stages = Stages(spark, "gapfill")
    n, e = stages.write(_nodes(spark, d), "nodes")[0], stages.write(_edges(spark, d), "edges")[0]
    return _with_bridges(spark, d, n, e, tr.bridges(tr.gap_pairs(n, e)), ("gap", "d", "e", "s"))


@_query()
def mt_nms(spark, d):
    """Nodes left by greedy suppression within 4 um, higher best p into the node first."""
    best = _edges(spark, d).groupBy("movie", F.col("target_id").alias("node_id")).agg(F.max("p").alias("score"))
    return tr.spaced(_nodes(spark, d).join(best, ["movie", "node_id"], "left"), 4.0, "score")


@_query(f"WITH {_NODES} SELECT movie, t, z, y, x, min(node_id) AS node_id, count(*) AS n FROM n GROUP BY ALL")
def mt_dedup(spark, d):
    """Nodes of one frame and place as one."""
    return _nodes(spark, d).groupBy("movie", "t", "z", "y", "x").agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("n"))


_BACK = """q1 AS (SELECT movie, target_id AS a, min(source_id) AS b FROM m GROUP BY ALL HAVING count(*) = 1), q2 AS (SELECT movie, source_id AS a, min(target_id) AS b FROM m GROUP BY ALL HAVING count(*) = 1),
ba AS (SELECT movie, node_id, node_id AS anc, 0 AS dt FROM nn UNION ALL SELECT ba.movie, node_id, b, dt - 1 FROM ba JOIN q1 ON ba.movie = q1.movie AND anc = a WHERE dt > -3),
fo AS (SELECT movie, node_id, node_id AS anc, 0 AS dt FROM nn UNION ALL SELECT fo.movie, node_id, b, dt + 1 FROM fo JOIN q2 ON fo.movie = q2.movie AND anc = a WHERE dt < 3),
al AS (SELECT * FROM ba UNION ALL SELECT * FROM fo WHERE dt > 0), pt AS (SELECT al.movie, al.node_id, dt, nn.z, nn.y, nn.x FROM al JOIN nn ON al.movie = nn.movie AND anc = nn.node_id),
ft AS (SELECT movie, node_id, count(*) AS k, regr_intercept(z, dt) AS fz, regr_intercept(y, dt) AS fy, regr_intercept(x, dt) AS fx, max(z) FILTER (dt = 0) AS z, max(y) FILTER (dt = 0) AS y, max(x) FILTER (dt = 0) AS x FROM pt GROUP BY ALL),
sm AS (SELECT movie, node_id, CASE WHEN k >= 3 THEN 0.2 * z + 0.8 * fz ELSE z END AS z, CASE WHEN k >= 3 THEN 0.2 * y + 0.8 * fy ELSE y END AS y, CASE WHEN k >= 3 THEN 0.2 * x + 0.8 * fx ELSE x END AS x FROM ft)"""


@_query(f"WITH RECURSIVE {_MOVES}, nn AS (SELECT movie, node_id, z_um AS z, y_um AS y, x_um AS x FROM n), {_BACK} SELECT movie, node_id, round(z + 1e-9, 4) AS z, round(y + 1e-9, 4) AS y, round(x + 1e-9, 4) AS x FROM sm")
def wn_linefit(spark, d):
    """Places drawn to the line through up to three chain neighbours before and after."""
    out = tr.smoothed(_nodes(spark, d), _edges(spark, d))
    return out.select("movie", "node_id", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in AXES))


@_query(f"""WITH RECURSIVE {_VELOCITY}, dr AS (SELECT movie, t, sum(vz) OVER w AS sz, sum(vy) OVER w AS sy, sum(vx) OVER w AS sx FROM v WINDOW w AS (PARTITION BY movie ORDER BY t)),
nn AS (SELECT n.movie, node_id, z_um - sz AS z, y_um - sy AS y, x_um - sx AS x, sz, sy, sx FROM n JOIN dr ON n.movie = dr.movie AND n.t = dr.t), {_BACK}
SELECT sm.movie, sm.node_id, round(sm.z + sz + 1e-9, 4) AS z, round(sm.y + sy + 1e-9, 4) AS y, round(sm.x + sx + 1e-9, 4) AS x FROM sm JOIN nn ON sm.movie = nn.movie AND sm.node_id = nn.node_id""")
def wn_stabilized_linefit(spark, d):
    """The same without the movie's drift, which is put back."""
    out = tr.stabilised(_nodes(spark, d), _edges(spark, d))
    return out.select("movie", "node_id", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in AXES))


# --- orders, sets, sinks, samples


@_query(f"WITH {_NODES} SELECT movie, node_id, row_number() OVER (PARTITION BY movie ORDER BY t, z, y, x, node_id) - 1 AS place FROM n")
def so_node_order(spark, d):
    """Place of each node in its movie by (t, z, y, x)."""
    from trackweave.functions.numbering import numbered_within

    order = [F.col(c) for c in ("t", "z", "y", "x", "node_id")]
    return numbered_within(_nodes(spark, d).select("movie", "node_id", "t", "z", "y", "x"), ["movie"], order, "place").select("movie", "node_id", "place")


@_query(f"WITH {_NODES}, m AS (SELECT DISTINCT movie FROM n) SELECT movie, (row_number() OVER (ORDER BY movie) - 1) % 4 AS shard FROM m")
def so_shard(spark, d):
    """Every fourth movie by name to one of four shards."""
    from trackweave.functions.numbering import numbered

    return numbered(_nodes(spark, d).select("movie").distinct(), [F.col("movie")], "r").select("movie", (F.col("r") % 4).alias("shard"))


SQL["src_movie_list"] = SQL["so_shard"]
QUERIES["src_movie_list"] = so_shard


@_query("SELECT movie, i, j FROM link_scores WHERE source = 'learned' UNION SELECT movie, i, j FROM link_scores WHERE source = 'embed'")
def st_union_distinct(spark, d):
    """Links of either of two evidences."""
    l = table(spark, d, "link_scores")
    return l.where("source = 'learned'").select("movie", "i", "j").union(l.where("source = 'embed'").select("movie", "i", "j")).distinct()


@_query("SELECT movie FROM track_nodes WHERE movie IS NOT NULL EXCEPT SELECT movie FROM route")
def st_except(spark, d):
    """Movies that have no route."""
    return table(spark, d, "track_nodes").select("movie").where("movie is not null").distinct().exceptAll(table(spark, d, "route").select("movie").distinct())


@_query("SELECT movie FROM track_nodes INTERSECT SELECT movie FROM track_edges")
def st_intersect(spark, d):
    """Movies that have nodes and edges."""
    return table(spark, d, "track_nodes").select("movie").intersect(table(spark, d, "track_edges").select("movie"))


_SUBMISSION = f"""{_NODES}, {_EDGES}, rows_ AS (SELECT movie AS dataset, 'node' AS row_type, node_id, t, CAST(round_even(z, 0) AS INT) AS z, CAST(round_even(y, 0) AS INT) AS y, CAST(round_even(x, 0) AS INT) AS x, -1 AS source_id, -1 AS target_id FROM n
UNION ALL SELECT movie, 'edge', -1, -1, -1, -1, -1, source_id, target_id FROM e)"""


def _rows(nodes, edges):
    """Node rows, places in whole voxels, and edge rows of a result, -1 where a column does not apply."""
    minus = F.lit(-1)
    n = nodes.select(F.col("movie").alias("dataset"), F.lit("node").alias("row_type"), "node_id", "t", *(F.rint(c).cast("int").alias(c) for c in AXES), minus.cast("long").alias("source_id"), minus.cast("long").alias("target_id"))
    e = edges.select(F.col("movie").alias("dataset"), F.lit("edge").alias("row_type"), minus.cast("long").alias("node_id"), minus.alias("t"), *(minus.alias(c) for c in AXES), "source_id", "target_id")
    return n.unionByName(e)


def _submission(spark, d):
    return _rows(_nodes(spark, d), _edges(spark, d))


@_query(f"WITH {_SUBMISSION} SELECT * FROM rows_")
def sink_submission(spark, d):
    """Node rows and edge rows of the result, -1 where a column does not apply."""
    return _submission(spark, d)


SQL["st_union_all"], QUERIES["st_union_all"] = SQL["sink_submission"], sink_submission


@_query(f"WITH {_SUBMISSION} SELECT row_number() OVER (ORDER BY dataset, row_type DESC, node_id, source_id, target_id) - 1 AS id, * FROM rows_")
def sink_add_id(spark, d):
    """The result with a global row id in file order, numbered without gathering the rows in one task."""
    from trackweave.functions.numbering import numbered

    return numbered(_submission(spark, d), [F.col("dataset"), F.desc("row_type"), F.col("node_id"), F.col("source_id"), F.col("target_id")], "id")


@_query(f"WITH {_NODES}, m AS (SELECT DISTINCT movie FROM n) SELECT movie, (row_number() OVER (ORDER BY movie) - 1) % 2 AS half FROM m")
def tr_halves(spark, d):
    """Alternating halves of the movies by name."""
    from trackweave.functions.numbering import numbered

    return numbered(_nodes(spark, d).select("movie").distinct(), [F.col("movie")], "r").select("movie", (F.col("r") % 2).alias("half"))


@_query("""SELECT recording, t0, min(z) AS z0, min(y) AS y0, min(x) AS x0, max(z + size_um) AS z1, max(y + size_um) AS y1, max(x + size_um) AS x1, count(*) AS n FROM (
SELECT DISTINCT id, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS recording, t0, origin_um[1] AS z, origin_um[2] AS y, origin_um[3] AS x, size_um FROM ultrack_windows WHERE len(origin_um) = 3 AND origin_um[1] + origin_um[2] + origin_um[3] IS NOT NULL AND NOT isnan(origin_um[1] + origin_um[2] + origin_um[3]) AND name IS NOT NULL) GROUP BY ALL""")
def tr_window_plan(spark, d):
    """The box around all windows of a recording and first frame."""
    w = table(spark, d, "ultrack_windows")
    o = F.col("origin_um")
    w = w.where((F.size(o) == 3) & ~F.exists(o, lambda v: v.isNull() | F.isnan(v)) & F.col("name").isNotNull())
    rows = w.select("id", F.lower(F.regexp_replace("name", "[^A-Za-z0-9]", "")).alias("recording"), "t0", o[0].alias("z"), o[1].alias("y"), o[2].alias("x"), "size_um").distinct()
    return rows.groupBy("recording", "t0").agg(*(F.min(c).alias(f"{c}0") for c in AXES), *(F.max(F.col(c) + F.col("size_um")).alias(f"{c}1") for c in AXES), F.count(F.lit(1)).alias("n"))


# --- matching and features


@_query()
def mt_hungarian_gate(spark, d):
    """Nodes of neighbouring frames matched within 7 um: most pairs, then least distance."""
    return mt.matched(sp.next_frame_pairs(_nodes(spark, d), 7.0)).drop("second")


@_query()
def mt_max_similarity(spark, d):
    """Nodes of neighbouring frames matched within 7 um with the greatest sum of 1 / (1 + d)."""
    return mt.matched(sp.next_frame_pairs(_nodes(spark, d), 7.0), similarity=True).drop("second")


@_query()
def mt_link_greedy(spark, d):
    """Matched links and adopted second children."""
    return mt.link_frames(_nodes(spark, d))


QUERIES["mt_second_child"] = mt_link_greedy


@_query()
def mt_link_frames(spark, d):
    """Nodes linked within 8 um without second children."""
    return mt.link_frames(_nodes(spark, d), 8.0, None).drop("second")


@_query()
def tr_pseudo_labels(spark, d):
    """Nodes linked from frame to frame with second children, tracks of three nodes and more or with a division, places drawn to the line through
    their neighbours, in voxels."""
    n = _nodes(spark, d)
    links, _ = Stages(spark, "pseudo").write(mt.link_frames(n, 7.0, 7.0), "links")
    tracks = links.select("movie", F.col("i").alias("source_id"), F.col("j").alias("target_id"), F.lit(1.0).alias("p"))
    kept, _ = Stages(spark, "pseudo").write(n.join(tr.long_tracks(n, tracks, 3), ["movie", "node_id"], "left_semi"), "kept")
    at = tr.smoothed(kept, tracks).join(kept.select("movie", "node_id", "t"), ["movie", "node_id"])
    return at.select("movie", "node_id", "t", *((F.col(c) / F.lit(s)).alias(c) for c, s in zip(AXES, SCALE_ZYX)))


@_query()
def mt_close_gaps(spark, d):
    """The result with gaps of one frame bridged by a matching of ends and starts up to 16 um apart."""
    stages = Stages(spark, "closed")
    n, e = stages.write(_nodes(spark, d), "nodes")[0], stages.write(_edges(spark, d), "edges")[0]
    return _with_bridges(spark, d, n, e, tr.close_gaps(n, e), ("gap", "e", "s"))


@_query()
def ft_edge26(spark, d):
    """The 26 geometry columns of each candidate link."""
    return ft.edge26(*_pool(spark, d))


def _pool(spark, d):
    """Nodes and candidate links, written once."""
    stages = Stages(spark, "pool")
    n, _ = stages.write(_nodes(spark, d), "nodes")
    with scope():
        return n, stages.write(sp.candidates(n), "links")[0]


_EVID = ["tf_fwd", "tf_harm", "embed", "learned"]


@_query(f"WITH {_SCORES}, v AS ({_PIVOT}) SELECT movie, i, j" + "".join(
    f", coalesce({c}, 0) AS {c}, row_number() OVER (PARTITION BY movie, i ORDER BY coalesce({c}, 0) DESC, j) - 1 AS {c}_rank_src, max(coalesce({c}, 0)) OVER (PARTITION BY movie, i) - coalesce({c}, 0) AS {c}_gap_src, row_number() OVER (PARTITION BY movie, j ORDER BY coalesce({c}, 0) DESC, i) - 1 AS {c}_rank_dst, max(coalesce({c}, 0)) OVER (PARTITION BY movie, j) - coalesce({c}, 0) AS {c}_gap_dst"
    for c in _EVID) + ", abs(coalesce(tf_fwd, 0) - coalesce(tf_harm, 0)) AS spread FROM v")
def ft_evidence21(spark, d):
    """The evidence part of the link features: value, ranks and gaps of each source, and one difference."""
    return ft.evidence21(_pivot(spark, d), _EVID)


@_query()
def ft_edge47(spark, d):
    """All 47 columns of each candidate link: geometry and evidences, 0 where there is none."""
    n, links = _pool(spark, d)
    return ft.edge47(n, links, _pivot(spark, d), _EVID)


@_query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos, round(least(greatest((list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 0), 1), 5) AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn_embed_sim(spark, d):
    """Cosine of neighbouring unit vectors and its share of 1."""
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("embedding").cast("array<double>").alias("u"))
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").cast("array<double>").alias("v"))
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "b").withColumn("c", dot).select("a", "b", F.round("c", 5).alias("cos"), F.round(F.least(F.greatest((F.col("c") + 1) / 2, F.lit(0.0)), F.lit(1.0)), 5).alias("p"))


SQL["fn_cosine"], QUERIES["fn_cosine"] = SQL["fn_embed_sim"], fn_embed_sim


@_query(f"""WITH {_LEARNED}, r AS (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY p DESC, j) AS r, max(p) OVER (PARTITION BY movie, i) AS out_best FROM l),
o AS (SELECT movie, i, max(p) AS out_best, count(*) AS out_n FROM l GROUP BY ALL),
w AS (SELECT a.movie, a.i AS u, a.j AS d1, b.j AS d2, a.p AS p1, b.p AS p2, a.r AS r1, b.r AS r2 FROM r a JOIN r b ON a.movie = b.movie AND a.i = b.i AND a.r < b.r AND b.r <= 3),
alt AS (SELECT movie, j, i, p, row_number() OVER (PARTITION BY movie, j ORDER BY p DESC, i) AS r FROM l)
SELECT w.movie, u, d1, d2, p1, p2, least(p1, p2) AS pmin, p1::DOUBLE + p2::DOUBLE AS psum, r1, r2, greatest(r1, r2) AS rmax,
coalesce((SELECT max(p) FROM alt x WHERE x.movie = w.movie AND x.j = d1 AND x.i <> u AND x.r <= 2), 0) AS io1, coalesce((SELECT max(p) FROM alt x WHERE x.movie = w.movie AND x.j = d2 AND x.i <> u AND x.r <= 2), 0) AS io2,
coalesce(o1.out_best, 0) AS out1, coalesce(o2.out_best, 0) AS out2, coalesce(o1.out_n, 0) AS n1, coalesce(o2.out_n, 0) AS n2
FROM w LEFT JOIN o o1 ON w.movie = o1.movie AND d1 = o1.i LEFT JOIN o o2 ON w.movie = o2.movie AND d2 = o2.i""")
def ft_best_pairs(spark, d):
    """Link columns of each mother and two of her three best targets: own, competing and onward probabilities."""
    return ft.link_pairs(_learned(spark, d))


@_query(f"""WITH {_LEARNED}, {_NODES}, r AS (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY p DESC, j) AS r, count(*) OVER (PARTITION BY movie, i) AS k FROM l),
t AS (SELECT movie, i, max(k) AS n_out, max(p) FILTER (r = 1) AS p1, coalesce(max(p) FILTER (r = 2), 0) AS p2, coalesce(max(p) FILTER (r = 3), 0) AS p3, max(j) FILTER (r = 1) AS c1, coalesce(max(j) FILTER (r = 2), -1) AS c2 FROM r GROUP BY ALL),
q AS (SELECT movie, j, max(p) AS q1, count(*) AS n_in FROM l GROUP BY ALL)
SELECT n.movie, node_id, n.t, coalesce(p1, 0) AS p1, coalesce(p2, 0) AS p2, coalesce(p3, 0) AS p3, coalesce(p2, 0)::DOUBLE / greatest(coalesce(p1, 0)::DOUBLE, CAST(1e-6 AS DOUBLE)) AS p2_p1, coalesce(p1, 0)::DOUBLE - coalesce(p2, 0)::DOUBLE AS margin,
coalesce(n_out, 0) AS n_out, coalesce(q1, 0) AS q1, coalesce(n_in, 0) AS n_in, (row_number() OVER (PARTITION BY n.movie, n.t ORDER BY coalesce(p2, 0), node_id) - 1) / greatest(count(*) OVER (PARTITION BY n.movie, n.t) - 1, 1) AS p2_pct
FROM n LEFT JOIN t ON n.movie = t.movie AND node_id = i LEFT JOIN q ON n.movie = q.movie AND node_id = q.j""")
def ft_node_links(spark, d):
    """The link columns of the node features (p1..p3, their ratios and ranks, degrees, best parent)."""
    return ft.node_links(_nodes(spark, d), _learned(spark, d))


@_query(f"WITH {_NODES}, {_LEARNED}, v AS (SELECT l.movie, t, round_even(z, 0) AS z, round_even(y, 0) AS y, round_even(x, 0) AS x, max(p) AS score FROM l JOIN n ON l.movie = n.movie AND i = node_id GROUP BY ALL) SELECT n.movie, node_id, coalesce(score, 0) AS score, score IS NOT NULL AS present FROM n LEFT JOIN v ON n.movie = v.movie AND n.t = v.t AND round_even(n.z, 0) = v.z AND round_even(n.y, 0) = v.y AND round_even(n.x, 0) = v.x")
def jn_divscore(spark, d):
    """A score joined to nodes by frame and rounded voxel, 0 where there is none."""
    n = _nodes(spark, d)
    at = [F.rint(c).alias(f"r{c}") for c in AXES]
    keyed = n.select("movie", "t", "node_id", *at)
    v = _learned(spark, d).withColumnRenamed("i", "node_id").join(keyed, ["movie", "node_id"]).groupBy("movie", "t", "rz", "ry", "rx").agg(F.max("p").alias("score"))
    return keyed.join(v, ["movie", "t", "rz", "ry", "rx"], "left").select("movie", "node_id", F.coalesce("score", F.lit(0.0).cast("float")).alias("score"), F.col("score").isNotNull().alias("present"))


_PAIRS = SQL["sj_pair_triplets"].removeprefix("WITH ")


@_query(f"""WITH {_PAIRS.rpartition("SELECT movie, u, d1, d2")[0].rstrip()}, tp AS (SELECT movie, u, d1, d2 FROM (SELECT *, row_number() OVER (PARTITION BY movie, u ORDER BY score, d1, d2) AS r FROM h) WHERE r <= 8), {_SCORES},
l AS (SELECT movie, i, j, p::DOUBLE AS p, row_number() OVER (PARTITION BY movie, i ORDER BY p DESC, j) AS r FROM s WHERE source = 'learned'),
hm AS (SELECT movie, i, j, p::DOUBLE AS h FROM s WHERE source = 'tf_harm'), em AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ot AS (SELECT movie, i, max(p) AS p, count(*) AS k FROM l GROUP BY ALL), alt AS (SELECT movie, j, i, p, row_number() OVER (PARTITION BY movie, j ORDER BY p DESC, i) AS r FROM l),
io AS (SELECT tp.movie, u, x.j, max(p) AS io FROM (SELECT DISTINCT movie, u, unnest([d1, d2]) AS j FROM tp) tp JOIN alt x ON tp.movie = x.movie AND tp.j = x.j AND x.i <> u AND x.r <= 2 GROUP BY ALL),
w AS (SELECT tp.movie, tp.u, d1, d2, coalesce(l1.p, 0) AS p1, coalesce(l2.p, 0) AS p2, coalesce(l1.r, 9) AS r1, coalesce(l2.r, 9) AS r2, coalesce(h1.h, 0) AS h1, coalesce(h2.h, 0) AS h2, coalesce(i1.io, 0) AS io1, coalesce(i2.io, 0) AS io2,
 coalesce(o1.p, 0) AS out1, coalesce(o2.p, 0) AS out2, coalesce(o1.k, 0) AS n1, coalesce(o2.k, 0) AS n2, coalesce(list_dot_product(eu.v, e1.v), 0) AS cos1, coalesce(list_dot_product(eu.v, e2.v), 0) AS cos2, coalesce(list_dot_product(e1.v, e2.v), 0) AS cos12
 FROM tp LEFT JOIN l l1 ON tp.movie = l1.movie AND tp.u = l1.i AND d1 = l1.j LEFT JOIN l l2 ON tp.movie = l2.movie AND tp.u = l2.i AND d2 = l2.j LEFT JOIN hm h1 ON tp.movie = h1.movie AND tp.u = h1.i AND d1 = h1.j LEFT JOIN hm h2 ON tp.movie = h2.movie AND tp.u = h2.i AND d2 = h2.j
 LEFT JOIN io i1 ON tp.movie = i1.movie AND tp.u = i1.u AND d1 = i1.j LEFT JOIN io i2 ON tp.movie = i2.movie AND tp.u = i2.u AND d2 = i2.j LEFT JOIN ot o1 ON tp.movie = o1.movie AND d1 = o1.i LEFT JOIN ot o2 ON tp.movie = o2.movie AND d2 = o2.i
 LEFT JOIN em eu ON tp.u = eu.vec_id LEFT JOIN em e1 ON d1 = e1.vec_id LEFT JOIN em e2 ON d2 = e2.vec_id)
SELECT movie, u, d1, d2, p1, p2, least(p1, p2) AS pmin, p1 + p2 AS psum, r1, r2, greatest(r1, r2) AS rmax, h1, h2, io1, io2, round(p1 / greatest(io1, CAST(1e-3 AS DOUBLE)), 6) AS over1, round(p2 / greatest(io2, CAST(1e-3 AS DOUBLE)), 6) AS over2,
 out1, out2, n1, n2, round(cos1, 5) AS cos1, round(cos2, 5) AS cos2, round(cos12, 5) AS cos12, 1 AS has1, 1 AS has2 FROM w""")
def ft_link22(spark, d):
    """The 22 link columns of each mother's pairs of possible daughters; the vector with a node's id stands for its embedding."""
    n, s = _nodes(spark, d), Stages(spark, "scores").write(_scores(spark, d), "scores")[0]
    vectors = n.select("movie", "node_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("v")), "node_id")
    of = lambda name: s.where(F.col("source") == name).select("movie", "i", "j", "p")
    out = ft.pair_links(sp.daughter_pairs(n), of("learned"), of("tf_harm"), vectors)
    return out.withColumns({c: F.round(c, k) for c, k in (("over1", 6), ("over2", 6), ("cos1", 5), ("cos2", 5), ("cos12", 5))})


def _way(a: str, b: str, name: str) -> str:
    return ", ".join(f"coalesce({b}.{c}_um - {a}.{c}_um, 0) AS {name}_{c}" for c in AXES)


def _len(v: str) -> str:
    return f"sqrt({v}_z * {v}_z + {v}_y * {v}_y + {v}_x * {v}_x)"


def _cos(u: str, v: str) -> str:
    norm = f"{_len(u)} * {_len(v)}"
    return f"CASE WHEN {norm} <= 1e-6 THEN 0 ELSE ({u}_z * {v}_z + {u}_y * {v}_y + {u}_x * {v}_x) / greatest({norm}, CAST(1e-6 AS DOUBLE)) END"


def _div(a: str, b: str) -> str:
    return f"({a}) / greatest({b}, CAST(1e-6 AS DOUBLE))"


_NODE53 = {
    "p1": "p1", "p2": "p2", "p3": "p3", "p2_over_p1": _div("p2", "p1"), "p1_minus_p2": "p1 - p2", "p3_over_p2": _div("p3", "p2"), "q1": "q1",
    "p2_rank": "(row_number() OVER (PARTITION BY movie, t ORDER BY p2, node_id) - 1) / greatest(count(*) OVER (PARTITION BY movie, t) - 1, 1)",
    "d1": "d1", "d2": "d2", "dsib": "dsib", "cos_sib": _cos("a", "b"), "dsib_over_d": _div("dsib", "d1 + d2"), "sym": _div("abs(d1 - d2)", "d1 + d2"), "d1_rel": _div("d1", "typical"), "d2_rel": _div("d2", "typical"),
    "c1_q1": "k1q1", "c2_q1": "k2q1", "p2_margin_c2": "p2 - CASE WHEN k2m1 = node_id THEN k2q2 ELSE k2q1 END", "p1_margin_c1": "p1 - CASE WHEN k1m1 = node_id THEN k1q2 ELSE k1q1 END", "c1_out": "k1p1", "c2_out": "k2p1",
    "mot_in": "mot", "cos_turn1": _cos("m", "a"), "cos_turn2": _cos("m", "b"), "mot_in_rel": _div("mot", "typical"), "cnn": "cnn",
    "cnn_rank": "(row_number() OVER (PARTITION BY movie, t ORDER BY cnn, node_id) - 1) / greatest(count(*) OVER (PARTITION BY movie, t) - 1, 1)",
    "trel": "t / greatest(max(t) OVER (PARTITION BY movie), 1)", "p2_x_cnn": "p2 * cnn", "dsib2": "dsib2", "dsib_growth": _div("dsib2", "dsib"), "cos_sib2": f"CASE WHEN onward THEN {_cos('e', 'f')} ELSE 0 END", "gc_min_p": "least(k1p1, k2p1)",
    "dsib13": _len("h"), "cos13": _cos("a", "c"), "dsib23": _len("i"), "cos23": _cos("b", "c"),
}
_NODE53_COUNTS = {
    "n_out": "n_out", "n_in": "n_in", "c1_is_mine": "coalesce(k1m1 = node_id, false)::INT", "c2_is_mine": "coalesce(k2m1 = node_id, false)::INT", "c1_nin": "k1n_in", "c2_nin": "k2n_in", "c1_nout": "k1n_out", "c2_nout": "k2n_out",
    "grand_div": "(k1p2 > CAST(0.44 AS DOUBLE))::INT + (k2p2 > CAST(0.44 AS DOUBLE))::INT", "dens15": "o15", "dens8": "o8", "dnext15": "x15", "dnext8": "x8", "ddens15": "x15 - o15", "ddens8": "x8 - o8",
}


@_query(f"""WITH {_NODES}, {_LEARNED}, v AS (SELECT movie, i, j, p::DOUBLE AS p FROM l WHERE p >= CAST(0.02 AS FLOAT) AND (movie, i) IN (SELECT (movie, node_id) FROM n) AND (movie, j) IN (SELECT (movie, node_id) FROM n)),
ot AS (SELECT movie, i AS node_id, count(*) AS n_out, max(p) FILTER (r = 1) AS p1, max(p) FILTER (r = 2) AS p2, max(p) FILTER (r = 3) AS p3, max(j) FILTER (r = 1) AS c1, max(j) FILTER (r = 2) AS c2, max(j) FILTER (r = 3) AS c3
 FROM (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY p DESC, j) AS r FROM v) GROUP BY ALL),
it AS (SELECT movie, j AS node_id, count(*) AS n_in, max(p) FILTER (r = 1) AS q1, max(p) FILTER (r = 2) AS q2, max(i) FILTER (r = 1) AS m1 FROM (SELECT *, row_number() OVER (PARTITION BY movie, j ORDER BY p DESC, i) AS r FROM v) GROUP BY ALL),
ba AS (SELECT n.movie, n.node_id, t, z_um, y_um, x_um, coalesce(p1, 0) AS p1, coalesce(p2, 0) AS p2, coalesce(p3, 0) AS p3, c1, c2, c3, coalesce(n_out, 0) AS n_out, coalesce(q1, 0) AS q1, coalesce(q2, 0) AS q2, m1, coalesce(n_in, 0) AS n_in
 FROM n LEFT JOIN ot ON n.movie = ot.movie AND n.node_id = ot.node_id LEFT JOIN it ON n.movie = it.movie AND n.node_id = it.node_id),
ow AS (SELECT movie, i, count(*) FILTER (d <= 15) AS o15, count(*) FILTER (d <= 8) AS o8 FROM ({_SAME}) GROUP BY ALL), nx AS (SELECT movie, i, count(*) FILTER (d <= 15) AS x15, count(*) FILTER (d <= 8) AS x8 FROM ({_NEXT}) GROUP BY ALL),
cn AS ({SQL["jn_divscore"].removeprefix(f"WITH {_NODES}, {_LEARNED}, ").join(["WITH ", ""])}),
w AS (SELECT a.movie, a.node_id, a.t, a.p1, a.p2, a.p3, a.n_out, a.q1, a.n_in, {_way("pa", "a", "m")}, {_way("a", "k1", "a")}, {_way("a", "k2", "b")}, {_way("a", "k3", "c")}, {_way("k1", "k2", "g")}, {_way("k1", "k3", "h")}, {_way("k2", "k3", "i")},
 {_way("a", "g1", "e")}, {_way("a", "g2", "f")}, {_way("g1", "g2", "s")}, g1.node_id IS NOT NULL AND g2.node_id IS NOT NULL AS onward, pa.node_id IS NOT NULL AS has_parent,
 {", ".join(f"coalesce(k{k}.{c}, 0) AS k{k}{c}" for k in (1, 2) for c in ("q1", "q2", "n_in", "p1", "p2", "n_out"))}, k1.m1 AS k1m1, k2.m1 AS k2m1, coalesce(o15, 0) AS o15, coalesce(o8, 0) AS o8,
 CASE WHEN (a.movie, a.t + 1) IN (SELECT (movie, t) FROM n) THEN coalesce(x15, 0) ELSE coalesce(o15, 0) + 1 END AS x15, CASE WHEN (a.movie, a.t + 1) IN (SELECT (movie, t) FROM n) THEN coalesce(x8, 0) ELSE coalesce(o8, 0) + 1 END AS x8, cn.score::DOUBLE AS cnn
 FROM ba a LEFT JOIN ba k1 ON a.movie = k1.movie AND a.c1 = k1.node_id LEFT JOIN ba k2 ON a.movie = k2.movie AND a.c2 = k2.node_id LEFT JOIN ba k3 ON a.movie = k3.movie AND a.c3 = k3.node_id
 LEFT JOIN ba g1 ON k1.movie = g1.movie AND k1.c1 = g1.node_id LEFT JOIN ba g2 ON k2.movie = g2.movie AND k2.c1 = g2.node_id LEFT JOIN ba pa ON a.movie = pa.movie AND a.m1 = pa.node_id
 LEFT JOIN ow ON a.movie = ow.movie AND a.node_id = ow.i LEFT JOIN nx ON a.movie = nx.movie AND a.node_id = nx.i LEFT JOIN cn ON a.movie = cn.movie AND a.node_id = cn.node_id),
y AS (SELECT *, {_len("m")} AS mot, {_len("a")} AS d1, {_len("b")} AS d2, {_len("g")} AS dsib, CASE WHEN onward THEN {_len("s")} ELSE 0 END AS dsib2 FROM w),
mo AS (SELECT movie, t, median(mot) AS med FROM y WHERE has_parent GROUP BY ALL), u AS (SELECT y.*, CASE WHEN med > 1e-6 THEN med ELSE 1 END AS typical FROM y LEFT JOIN mo ON y.movie = mo.movie AND y.t = mo.t)
SELECT movie, node_id, {", ".join(f"round({x}, 6) + 0 AS {c}" for c, x in _NODE53.items())}, {", ".join(f"{x} AS {c}" for c, x in _NODE53_COUNTS.items())} FROM u""")
def ft_node53(spark, d):
    """The 53 columns of every node over the learned links of p >= 0.02; the score of ``jn_divscore`` stands for the division network's."""
    stages = Stages(spark, "nodes53")
    n, links = stages.write(_nodes(spark, d), "nodes")[0], stages.write(gr_candidate_graph(spark, d), "links")[0]
    return ft.node53(n, links, jn_divscore(spark, d)).withColumns({c: F.round(c, 6) for c in _NODE53})


# --- scores, labels and samples


@_query(f"""WITH {_NODES}, sc AS (SELECT movie, round_even(z, 3) AS z, round_even(y, 3) AS y, round_even(x, 3) AS x, max_by(p, ingested_at) AS seed, count(*) AS size FROM (SELECT n.movie, n.z, n.y, n.x, e.p, e.ingested_at FROM track_edges e JOIN n ON e.movie = n.movie AND e.source_id = n.node_id WHERE e.p IS NOT NULL) GROUP BY 1, 2, 3, 4),
j AS (SELECT n.movie, node_id, size AS found, coalesce(size, 0) AS size FROM n LEFT JOIN sc ON n.movie = sc.movie AND round_even(n.z, 3) = sc.z AND round_even(n.y, 3) = sc.y AND round_even(n.x, 3) = sc.x),
m AS (SELECT movie, median(size) AS med, bool_or(found IS NULL) AS missed FROM j GROUP BY movie)
SELECT j.movie, node_id, CASE WHEN missed AND size = 0 THEN med ELSE size END AS size FROM j JOIN m USING (movie)""")
def jn_scores_to_nodes(spark, d):
    """Sizes joined to nodes by coordinates rounded to three decimals; if any node of a movie missed, its zeros become the movie's median."""
    n = _nodes(spark, d)
    at = [F.bround(c, 3).alias(f"r{c}") for c in AXES]
    e = table(spark, d, "track_edges").where("p is not null").select("movie", F.col("source_id").alias("node_id"))
    sc = e.join(n, ["movie", "node_id"]).groupBy("movie", *at).agg(F.count(F.lit(1)).alias("found"))
    rows = n.select("movie", "node_id", *at).join(sc, ["movie", "rz", "ry", "rx"], "left").withColumn("size", F.coalesce("found", F.lit(0)).cast("double"))
    med = rows.groupBy("movie").agg(F.percentile("size", F.lit(0.5)).alias("med"), F.bool_or(F.col("found").isNull()).alias("missed"))
    return rows.join(med, "movie").select("movie", "node_id", F.when(F.col("missed") & (F.col("size") == 0), F.col("med")).otherwise(F.col("size")).alias("size"))


@_query(f"""WITH {_EDGES}, {_LEARNED}, c AS (SELECT movie, source_id AS u, list_sort(list(target_id)) AS kids FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY p DESC, j) AS r FROM l), w AS (SELECT movie, i AS u, least(max(j) FILTER (r = 1), max(j) FILTER (r = 2)) AS d1, greatest(max(j) FILTER (r = 1), max(j) FILTER (r = 2)) AS d2 FROM r WHERE r <= 2 GROUP BY ALL HAVING count(*) = 2)
SELECT w.movie, w.u, d1, d2, CASE WHEN len(kids) = 1 THEN 0 WHEN len(kids) = 2 THEN (kids[1] = d1 AND kids[2] = d2)::INT END AS y FROM w LEFT JOIN c ON w.movie = c.movie AND w.u = c.u""")
def jn_event_label(spark, d):
    """Label of a mother and her two best targets: 0 if she has one child, with two whether they are these, else none."""
    c = _edges(spark, d).groupBy("movie", F.col("source_id").alias("u")).agg(F.count(F.lit(1)).alias("k"), F.min("target_id").alias("k1"), F.max("target_id").alias("k2"))
    two = lk.top_links(_learned(spark, d)).where("degree >= 2").select("movie", F.col("i").alias("u"), F.least("c1", "c2").alias("d1"), F.greatest("c1", "c2").alias("d2"))
    y = F.when(F.col("k") == 1, 0).when(F.col("k") == 2, ((F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2"))).cast("int"))
    return two.join(c, ["movie", "u"], "left").select("movie", "u", "d1", "d2", y.alias("y"))


@_query(f"WITH {_NODES}, w AS ({_SAME}) SELECT n.movie, node_id, count(i) FILTER (d <= 10) AS near, count(i) AS wide FROM n LEFT JOIN w ON n.movie = w.movie AND node_id = i AND d <= 20 GROUP BY ALL")
def sj_density_pair(spark, d):
    """Other nodes of the frame within 10 and 20 um."""
    n = _nodes(spark, d)
    a, b = sp.crowding(n, 10.0).withColumnRenamed("n", "near"), sp.crowding(n, 20.0).withColumnRenamed("n", "wide")
    return a.join(b, ["movie", "node_id"])


@_query(f"WITH {_NODES} SELECT a.movie, a.t, count(*) AS pairs FROM (SELECT movie, t, count(*) AS k FROM n GROUP BY ALL) a JOIN (SELECT movie, t, count(*) AS k FROM n GROUP BY ALL) b ON a.movie = b.movie AND b.t = a.t + 1 GROUP BY ALL")
def tj_next_frame(spark, d):
    """Frames that have a next one."""
    f = _nodes(spark, d).groupBy("movie", "t").agg(F.count(F.lit(1)).alias("k"))
    return f.join(f.select("movie", (F.col("t") - 1).alias("t")), ["movie", "t"]).groupBy("movie", "t").agg(F.count(F.lit(1)).alias("pairs"))


@_query(_LINKED + f""", ra AS (SELECT n.* FROM n WHERE (movie, node_id) IN (SELECT (movie, source_id) FROM e)), su AS (SELECT a.movie, a.node_id,
 EXISTS (SELECT 1 FROM ra b WHERE b.movie = a.movie AND b.t = a.t AND {_DIST} <= 6) AS s FROM n a), sh AS (SELECT cc.movie, comp, avg(s::INT) AS share FROM cc JOIN su ON cc.movie = su.movie AND cc.node_id = su.node_id GROUP BY ALL)
SELECT cc.movie, cc.node_id, cc.comp, round(share, 6) AS share FROM cc JOIN sh ON cc.movie = sh.movie AND cc.comp = sh.comp WHERE share >= 0.5""")
def ag_component_support(spark, d):
    """Nodes of components of which at least half is supported within 6 um."""
    n, e = _nodes(spark, d), _edges(spark, d)
    ref = n.join(e.select("movie", F.col("source_id").alias("node_id")), ["movie", "node_id"], "left_semi")
    rows = tr.components(n, e).join(sp.supported(n, ref, 6.0), ["movie", "node_id"])
    share = rows.groupBy("movie", "comp").agg(F.avg(F.col("supported").cast("int")).alias("share")).where("share >= 0.5")
    return rows.join(share, ["movie", "comp"]).select("movie", "node_id", "comp", F.round("share", 6).alias("share"))


@_query()
def gr_support_tracks(spark, d):
    """Tracks of a second model supported by the first, with its scores: recorded targets stand for the second's points, recorded sources, with
    their best p and number of edges, for the first's."""
    stages = Stages(spark, "support")
    n, e = stages.write(_nodes(spark, d), "nodes")[0], stages.write(_edges(spark, d), "edges")[0]
    second = n.join(e.select("movie", F.col("target_id").alias("node_id")), ["movie", "node_id"], "left_semi")
    scores = e.groupBy("movie", F.col("source_id").alias("node_id")).agg(F.coalesce(F.max("p").cast("double"), F.lit(0.0)).alias("seed"), F.count(F.lit(1)).cast("double").alias("size"))
    return tr.refined(second, n.join(scores, ["movie", "node_id"]))


@_query(f"WITH {_LEARNED}, r AS (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY p DESC, j) AS r FROM l), w AS (SELECT a.movie, a.i AS u, a.p::DOUBLE * b.p::DOUBLE AS score FROM r a JOIN r b ON a.movie = b.movie AND a.i = b.i AND a.r < b.r AND b.r <= 3) SELECT movie, u, max(score) AS score, round(avg(1 / (1 + exp(-(2 * score - 1)))), 6) AS mean FROM w GROUP BY ALL")
def ag_best_pair(spark, d):
    """Best and mean calibrated score of each mother's pairs."""
    w = ft.link_pairs(_learned(spark, d)).withColumn("score", F.col("p1").cast("double") * F.col("p2").cast("double"))
    return w.groupBy("movie", "u").agg(F.max("score").alias("score"), F.round(F.avg(1 / (1 + F.exp(-(2 * F.col("score") - 1)))), 6).alias("mean"))


@_query(f"WITH {_SCORES} SELECT movie, i, j, round(avg(p), 6) AS p FROM s GROUP BY ALL")
def ag_ensemble_mean(spark, d):
    """Mean score of each link over all evidences that have one."""
    return _scores(spark, d).groupBy("movie", "i", "j").agg(F.round(F.avg("p"), 6).alias("p"))


@_query(f"WITH {_LEARNED} SELECT movie, i, j, round(1 / (1 + exp(-(2 * p::DOUBLE - 1))), 9) AS q FROM l")
def fn_sigmoid_cal(spark, d):
    """The calibrated score of every link: the logistic function of a line in p."""
    return _learned(spark, d).select("movie", "i", "j", F.round(1 / (1 + F.exp(-(2 * F.col("p").cast("double") - 1))), 9).alias("q"))


@_query("""WITH b AS (SELECT user_id, datediff('day', TIMESTAMP '2024-01-01', ts)::DOUBLE AS t, max(value) AS v FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND ts IS NOT NULL GROUP BY ALL),
sl AS (SELECT a.user_id, median((c.v - a.v) / (c.t - a.t)) AS slope, avg(((c.v - a.v) / (c.t - a.t) > 0)::INT) AS rising FROM b a JOIN b c ON a.user_id = c.user_id AND c.t > a.t GROUP BY ALL),
ft AS (SELECT b.user_id, b.t, b.v, b.v - coalesce(slope, 0) * b.t AS q FROM b LEFT JOIN sl ON b.user_id = sl.user_id),
md AS (SELECT user_id, median(abs(q - base)) AS spread FROM (SELECT *, median(q) OVER (PARTITION BY user_id) AS base FROM ft) GROUP BY ALL),
st AS (SELECT user_id, t, v, v - lag(v) OVER w AS step, (v - lag(v) OVER w) / (t - lag(t) OVER w) AS r, max(v) OVER w - v AS fall, first_value(v) OVER w AS v0 FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t)),
x AS (SELECT user_id, count(*) AS n, arg_max(v, t) - max(v0) AS net, max(fall) AS draw_down, coalesce(sum(greatest(-step, 0)), 0) AS decrease, max(v0) AS v0, count(*) FILTER (v > v0) AS over_first, coalesce(min(r), 0) AS min_step, coalesce(max(r), 0) AS max_step, max(t) - min(t) AS span FROM st GROUP BY ALL)
SELECT x.user_id, n, round(coalesce(slope, 0), 6) AS slope, round(coalesce(rising, 0), 6) AS rising, round(net, 6) AS net, round(draw_down, 6) AS draw_down, round(decrease, 6) AS decrease, round(spread, 6) AS spread,
CASE WHEN n > 1 THEN round(net / nullif(1 + v0, 0), 6) ELSE 0 END AS relative, CASE WHEN n > 1 THEN round(over_first::DOUBLE / (n - 1), 6) ELSE 0 END AS above, round(min_step, 6) AS min_step, round(max_step, 6) AS max_step, span
FROM x LEFT JOIN sl ON x.user_id = sl.user_id LEFT JOIN md ON x.user_id = md.user_id""")
def wn_trend(spark, d):
    """The 12 trend statistics of each user's daily best value; ``decrease`` is the sum of the falls."""
    ev = table(spark, d, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("t"), "value").where("user_id is not null")
    out = sm.trend(ev, ["user_id"], "t", "value").withColumn("decrease", F.col("fallen"))
    return out.select("user_id", "n", *(F.round(c, 6).alias(c) for c in ("slope", "rising", "net", "draw_down", "decrease", "spread", "relative", "above", "min_step", "max_step")), "span")


@_query(f"""WITH {_SCORES}, fr AS (SELECT movie, node_id, t FROM (SELECT *, row_number() OVER (PARTITION BY movie, node_id ORDER BY ingested_at DESC NULLS LAST, t DESC NULLS LAST) AS rn
 FROM track_nodes WHERE movie IS NOT NULL AND node_id IS NOT NULL) WHERE rn = 1)
SELECT movie, source, i, j, p FROM (SELECT s.*, t, row_number() OVER (PARTITION BY s.movie, source, t ORDER BY p DESC, i, j) AS r FROM s LEFT JOIN fr ON s.movie = fr.movie AND i = node_id) WHERE r <= {MOST_PEAKS} OR t IS NULL""")
def so_max_peaks(spark, d):
    """The 40,000 strongest links of each movie, evidence and frame of the source node; all of those whose source has no frame."""
    rows = table(spark, d, "track_nodes").where("movie is not null and node_id is not null")
    frames = current_rows(rows, ["movie", "node_id"], "ingested_at", ["t", *AXES]).select("movie", F.col("node_id").alias("i"), "t")
    return lk.strongest(_scores(spark, d).join(frames, ["movie", "i"], "left"), MOST_PEAKS).select("movie", "source", "i", "j", "p")


@_query()
def tr_neg_sample(spark, d):
    """At most 200 nodes of each movie that are no mothers and lie neither in the first nor the last frame."""
    n, e = _nodes(spark, d), _edges(spark, d)
    mothers = e.groupBy("movie", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    last = n.groupBy("movie").agg(F.max("t").alias("last"))
    rows = n.join(mothers, ["movie", "node_id"], "left_anti").join(last, "movie").where("t >= 1 and t < last")
    return sm.per_group(rows.select("movie", "node_id", "t"), "movie", "node_id", 200, 1)


@_query()
def tr_epoch_items(spark, d):
    """At most 16 frames of each movie."""
    return sm.per_group(_nodes(spark, d).select("movie", "t").distinct(), "movie", "t", 16, 7)


@_query(f"WITH {_NODES}, m AS (SELECT DISTINCT movie FROM n) SELECT movie, (row_number() OVER (PARTITION BY substr(movie, 1, 4) ORDER BY movie) - 1) % 5 AS fold FROM m")
def tr_folds(spark, d):
    """Five folds, dealt in turn to the movies of each embryo (the name's first part)."""
    m = _nodes(spark, d).select("movie").distinct()
    return m.select("movie", ((F.row_number().over(Window.partitionBy(F.substring("movie", 1, 4)).orderBy("movie")) - 1) % 5).alias("fold"))


@_query(f"WITH {_NODES}, {_LEARNED} SELECT l.movie, i, j, p, sqrt((b.z - a.z) * (b.z - a.z) + (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x)) AS vox FROM l JOIN n a ON l.movie = a.movie AND i = a.node_id JOIN n b ON l.movie = b.movie AND j = b.node_id WHERE p >= CAST(0.02 AS FLOAT)")
def gr_candidate_graph(spark, d):
    """Candidate edges with p >= 0.02 and their length in voxels."""
    n = _nodes(spark, d)
    a = n.select("movie", F.col("node_id").alias("i"), *(F.col(c).alias(f"{c}_a") for c in AXES))
    b = n.select("movie", F.col("node_id").alias("j"), *(F.col(c).alias(f"{c}_b") for c in AXES))
    rows = _learned(spark, d).where(F.col("p") >= F.lit(0.02).cast("float")).join(a, ["movie", "i"]).join(b, ["movie", "j"])
    return rows.select("movie", "i", "j", "p", distance("_a", "_b").alias("vox"))


@_query(f"WITH {_MOVES}, q AS (SELECT a.movie, a.target_id AS u, a.dz AS az, a.dy AS ay, a.dx AS ax, b.target_id AS w, b.dz AS bz, b.dy AS by_, b.dx AS bx FROM m a JOIN m b ON a.movie = b.movie AND a.target_id = b.source_id), v AS (SELECT *, sqrt(az * az + ay * ay + ax * ax) * sqrt(bz * bz + by_ * by_ + bx * bx) AS norm FROM q) SELECT movie, u, w, round(CASE WHEN norm <= 1e-6 THEN 0 ELSE (az * bz + ay * by_ + ax * bx) / greatest(norm, 1e-6) END, 6) AS turn, count(*) AS n FROM v GROUP BY ALL")
def fn_motion_cosine(spark, d):
    """Cosine between the motion into a node and that out of it."""
    from trackweave.functions.geometry import cosine

    m = tr.motions(_nodes(spark, d), _edges(spark, d))
    a = m.select("movie", F.col("j").alias("u"), *(F.col(f"d{c}").alias(f"a{c}") for c in AXES))
    b = m.select("movie", F.col("i").alias("u"), F.col("j").alias("w"), *(F.col(f"d{c}").alias(f"b{c}") for c in AXES))
    turn = cosine([F.col(f"a{c}") for c in AXES], [F.col(f"b{c}") for c in AXES])
    return a.join(b, ["movie", "u"]).groupBy("movie", "u", "w", F.round(turn, 6).alias("turn")).agg(F.count(F.lit(1)).alias("n"))


def _labelled(spark, d):
    """``_pivot`` with the label ``y`` of ``jn_gt_child`` and whether there is a learned p.

    Edges go along with the scores as rows without a source, so that pivot, label and ranks by source node need one exchange.
    """
    kinds = dict(table(spark, d, "link_scores").dtypes)
    edge = {"source": F.lit(None), "scored_at": F.lit(None), "p": F.lit(1.0)}
    e = _edges(spark, d).select("movie", F.col("source_id").alias("i"), F.col("target_id").alias("j"), *(v.cast(kinds[c]).alias(c) for c, v in edge.items()))
    rows = _scores(spark, d, ["movie", "i"], e).groupBy("movie", "i", "j").agg(*_evidences(), F.max(F.col("source").isNull()).alias("hit"), F.max(F.col("source").isNotNull()).alias("scored"))
    rows = rows.withColumn("has", F.max("hit").over(Window.partitionBy("movie", "i"))).where("scored")
    return rows.select("movie", "i", "j", *_EVID, F.when(F.col("hit"), 1).when(F.col("has"), 0).alias("y"), F.col("learned").isNotNull().alias("is_learned"))


@_query()
def tr_edge_lgbm(spark, d):
    """Out-of-fold probability of each link from its evidence columns, two halves of the movies, boosted trees."""
    stages = Stages(spark, "ranks")
    cols = ft.evidence21(_labelled(spark, d), _EVID, ("y", "is_learned"), stages)
    halves = F.broadcast(tr_halves(spark, d))  # a row a movie
    features = [c for c in cols.columns if c not in ("movie", "i", "j", "y", "is_learned")]
    return sc_.out_of_fold(cols.where("is_learned").join(halves, "movie"), features, "y", "half", 2, ["movie", "i", "j", "y"], spent=stages)


QUERIES["md_edge_lgbm"] = tr_edge_lgbm


# --- small column operators


@_query("""SELECT event_type, event_id, round(greatest((value - a) / (b - a + 1e-6), 0), 8) AS v FROM events JOIN (SELECT event_type, quantile_cont(value, 0.001) AS a, quantile_cont(value, 0.999) AS b FROM events GROUP BY 1) USING (event_type)""")
def prj_quantile_scale(spark, d):
    """Scaling by stored quantiles, kept as a map of their names, not below 0."""
    ev = table(spark, d, "events")
    q = ev.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.001), F.lit(0.999))).alias("q"))
    q = q.select("event_type", F.create_map(F.lit("0.001"), F.col("q")[0], F.lit("0.999"), F.col("q")[1]).alias("quantiles"))
    lo, hi = F.col("quantiles")["0.001"], F.col("quantiles")["0.999"]
    return ev.join(q, "event_type").select("event_type", "event_id", F.round(F.greatest((F.col("value") - lo) / (hi - lo + 1e-6), F.lit(0.0)), 8).alias("v"))


@_query("""SELECT event_type, event_id, round((ln(1 + value) - m) / (s + 1e-3), 6) AS v FROM events JOIN (SELECT event_type, avg(ln(1 + value)) AS m, stddev_samp(ln(1 + value)) AS s FROM events GROUP BY 1) USING (event_type)""")
def prj_log1p_zscore(spark, d):
    """log1p, then z-score in the group with the deviation raised by 1e-3."""
    ev = table(spark, d, "events")
    q = ev.groupBy("event_type").agg(F.avg(F.log1p("value")).alias("m"), F.stddev_samp(F.log1p("value")).alias("s"))
    return ev.join(q, "event_type").select("event_type", "event_id", F.round((F.log1p("value") - F.col("m")) / (F.col("s") + 1e-3), 6).alias("v"))


@_query("SELECT movie, i, j, source, CASE WHEN p IS NULL OR isnan(p) THEN 0 ELSE p END AS zero, CASE WHEN p IS NULL OR isnan(p) THEN -1 ELSE p END AS minus, count(*) AS n FROM link_scores GROUP BY ALL")
def prj_nan_fill(spark, d):
    """Null and NaN as 0 and as -1."""
    fill = lambda v: F.coalesce(F.nanvl("p", F.lit(v).cast("float")), F.lit(v).cast("float"))
    return table(spark, d, "link_scores").groupBy("movie", "i", "j", "source", fill(0.0).alias("zero"), fill(-1.0).alias("minus")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_LINKS}, w AS ({_SAME}), nn AS (SELECT n.movie, node_id, least(coalesce(min(d), 15.0), 15.0) AS nnd FROM n LEFT JOIN w ON n.movie = w.movie AND node_id = i GROUP BY ALL) SELECT k.movie, i, j, least(d, 8.0) AS d_cap, d / greatest(nnd, 1e-6) AS d_nnd FROM k JOIN nn ON k.movie = nn.movie AND i = node_id")
def prj_safe_div(spark, d):
    """Link length, capped, and over the source's nearest distance, which counts at least 1e-6."""
    n = _nodes(spark, d)
    rows = sp.next_frame_pairs(n).join(sp.nearest_in_frame(n).withColumnRenamed("node_id", "i"), ["movie", "i"])
    return rows.select("movie", "i", "j", F.least("d", F.lit(8.0)).alias("d_cap"), safe_div(F.col("d"), F.col("nnd")).alias("d_nnd"))


SQL["prj_clip_feature"], QUERIES["prj_clip_feature"] = SQL["prj_safe_div"], prj_safe_div


@_query(SQL["jn_gt_child"].replace("SELECT l.movie", "SELECT * FROM (SELECT l.movie") + ") WHERE y IS NOT NULL")
def flt_labelled(spark, d):
    """Labelled links only."""
    return jn_gt_child(spark, d).where("y is not null")


@_query(SQL["ag_cluster"].replace("GROUP BY ALL", "GROUP BY ALL HAVING count(*) >= 2"))
def flt_min_cluster(spark, d):
    """Cells of at least two points."""
    return ag_cluster(spark, d).where("n >= 2")


@_query(f"WITH {_GAPS} SELECT movie, e, s, t, round(z_um, 9) AS z, round(y_um, 9) AS y, round(x_um, 9) AS x FROM pt WHERE (movie, e, s, gap) NOT IN (SELECT (movie, e, s, gap) FROM bad)")
def fn_interp(spark, d):
    """Points interpolated over the gaps that may be bridged."""
    n, g = _nodes(spark, d), tj_gap(spark, d)
    a = n.select("movie", F.col("node_id").alias("e"), "t", *(F.col(f"{c}_um").alias(f"{c}_a") for c in AXES))
    b = n.select("movie", F.col("node_id").alias("s"), *(F.col(f"{c}_um").alias(f"{c}_b") for c in AXES))
    rows = g.join(a, ["movie", "e"]).join(b, ["movie", "s"]).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("gap"))))
    at = lambda c: F.round(F.col(f"{c}_a") + (F.col(f"{c}_b") - F.col(f"{c}_a")) * F.col("k") / (F.col("gap") + 1), 9).alias(c)
    return rows.select("movie", "e", "s", (F.col("t") + F.col("k")).cast("int").alias("t"), *(at(c) for c in AXES))


@_query(f"WITH {_NODES} SELECT movie, node_id" + "".join(f", round(sin({2**k} * pi() * z / 67), 6) AS s{k}, round(cos({2**k} * pi() * z / 67), 6) AS c{k}" for k in range(4)) + " FROM n")
def fn_sincos_pos(spark, d):
    """Sine and cosine of the depth at four frequencies."""
    cols = []
    for k in range(4):
        angle = F.lit(2.0**k) * F.pi() * F.col("z") / 67
        cols += [F.round(F.sin(angle), 6).alias(f"s{k}"), F.round(F.cos(angle), 6).alias(f"c{k}")]
    return _nodes(spark, d).select("movie", "node_id", *cols)


@_query("SELECT id, split_part(id, '_', 1) AS prefix, split_part(id, '_', -1) AS last, regexp_replace(id, '_w[0-9]+$', '') AS stem, count(*) AS n FROM ultrack_windows GROUP BY ALL")
def fn_string(spark, d):
    """Parts of window ids."""
    i = F.col("id")
    return table(spark, d, "ultrack_windows").groupBy("id", F.split_part(i, F.lit("_"), F.lit(1)).alias("prefix"), F.split_part(i, F.lit("_"), F.lit(-1)).alias("last"), F.regexp_replace(i, "_w[0-9]+$", "").alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {_LINKS}, w AS ({_SAME}), nn AS (SELECT n.movie, node_id, n.t, n.z_um, n.y_um, n.x_um, least(coalesce(min(d), 15.0), 15.0) AS nnd FROM n LEFT JOIN w ON n.movie = w.movie AND node_id = i GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY movie, i ORDER BY d, j) AS a, row_number() OVER (PARTITION BY movie, j ORDER BY d, i) AS b FROM k),
an AS (SELECT p.movie, p.t, p.node_id, p.z_um, p.y_um, p.x_um, q.z_um - p.z_um AS mz, q.y_um - p.y_um AS my, q.x_um - p.x_um AS mx FROM r JOIN n p ON r.movie = p.movie AND i = p.node_id JOIN n q ON r.movie = q.movie AND j = q.node_id WHERE a = 1 AND b = 1 AND d < 6)
SELECT a.movie, a.node_id AS i, count(*) AS tis_n, median(mz) AS fz, median(my) AS fy, median(mx) AS fx FROM nn a JOIN an b ON a.movie = b.movie AND a.t = b.t AND a.node_id <> b.node_id WHERE {_DIST} <= 3 * greatest(nnd, 4.0) AND {_DIST} <= 45 GROUP BY ALL HAVING count(*) >= 2""")
def sj_flow_mutual(spark, d):
    """Median displacement of short mutual links around each node, within three times its nearest distance."""
    n = _nodes(spark, d)
    return ft.flow(n, sp.nearest_in_frame(n), lk.mutual_best(sp.next_frame_pairs(n)))


@_query()
def sj_flow_anchor(spark, d):
    """Median displacement of short first-pass links around each node, within three times its nearest distance."""
    stages = Stages(spark, "flow")
    n, _ = stages.write(_nodes(spark, d), "nodes")
    nnd, first = stages.write(sp.nearest_in_frame(n), "nnd")[0], stages.write(mt.link_frames(n, 7.0, 5.0), "first")[0]
    return ft.flow(n, nnd, first)


@_query(f"WITH {_NODES} SELECT movie, node_id, t, z, y, x FROM n")
def gr_coords_by_id(spark, d):
    """Places by node."""
    return _nodes(spark, d).select("movie", "node_id", "t", "z", "y", "x")


@_query(f"""WITH {_NODES}, {_EDGES}, g AS (SELECT movie, source_id AS u, min(target_id) AS a, max(target_id) AS b FROM e GROUP BY ALL HAVING count(*) = 2), w AS ({SQL["sj_pair_triplets"].replace("WITH " + _NODES + ", ", "SELECT * FROM (WITH ")}))
SELECT w.movie, w.u, d1, d2, CASE WHEN g.u IS NULL THEN 0 WHEN (d1 = a AND d2 = b) THEN 1 END AS y FROM w LEFT JOIN g ON w.movie = g.movie AND w.u = g.u""")
def jn_triplet_label(spark, d):
    """Label of a mother's pair: 1 if it is hers, none for her other pairs, 0 for those of nodes without two children."""
    g = _edges(spark, d).groupBy("movie", F.col("source_id").alias("u")).agg(F.count(F.lit(1)).alias("k"), F.min("target_id").alias("a"), F.max("target_id").alias("b")).where("k = 2")
    rows = sp.daughter_pairs(_nodes(spark, d)).join(g, ["movie", "u"], "left")
    return rows.select("movie", "u", "d1", "d2", F.when(F.col("k").isNull(), 0).when((F.col("d1") == F.col("a")) & (F.col("d2") == F.col("b")), 1).alias("y"))
