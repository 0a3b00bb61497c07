"""Queries of the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave import reference_queries as reference
from trackweave.operators import hierarchy as trees
from trackweave.operators.near import near_points
from trackweave.operators.regions import points_in_regions
from trackweave.sources.tables import located_nodes, table, valid_edges


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes of a movie that lie in one frame at most 6.5 um apart."""
    nodes = located_nodes(table(spark, d, "track_nodes"))
    return near_points(nodes, ["movie", "t"], "node_id", ["z_um", "y_um", "x_um"], 6.5).select("movie", "node_a", "node_b")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return trees.best_parents(valid_edges(table(spark, d, "track_edges"), table(spark, d, "track_nodes")), ["movie"], "source_id", "target_id", "p")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Founding node and depth of every node with a parent; -1 where the chain never ends."""
    parents = _parents(spark, d)
    found = trees.hierarchy(parents, ["movie"])
    return found.where("depth <> 0").select("movie", F.col("node").alias("node_id"), "root_id", "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, subtree size and preorder number of every node that has a parent or a child."""
    found = trees.hierarchy(_parents(spark, d), ["movie"], paths=True)
    return found.withColumnRenamed("node", "node_id")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node whose id is divisible by 20."""
    parents = _parents(spark, d)
    tree = trees.hierarchy(parents, ["movie"], paths=True)
    asked = tree.where("node % 20 = 0").select("movie", "node")
    return trees.descendants(tree, ["movie"], asked).select("movie", F.col("node").alias("node_id"), "descendant")


def p4_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node that has any, as ``p4_descendants`` gives them of each twentieth, which its SQL asks for."""
    tree = trees.hierarchy(_parents(spark, d), ["movie"], paths=True)
    return trees.descendants(tree, ["movie"], tree.select("movie", "node")).select("movie", F.col("node").alias("node_id"), "descendant")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """(recording, id, y, x, size) of every window with a complete origin."""
    o = F.col("origin_um")
    w = table(spark, d, "ultrack_windows").where("id is not null and name is not null and size_um is not null").where((F.size(o) == 3) & ~F.exists(o, lambda v: v.isNull() | F.isnan(v)))
    one = w.groupBy("id").agg(F.max(F.struct(F.lower(F.regexp_replace("name", "[^A-Za-z0-9]", "")).alias("recording"), o[1].alias("y"), o[2].alias("x"), F.col("size_um").alias("size"))).alias("w"))
    return one.select("w.recording", "id", "w.y", "w.x", "w.size")


def p2_regions(spark: SparkSession, d: str) -> DataFrame:
    """Of the middle of every window, the windows of its recording whose square in y and x contains it."""
    boxes = _boxes(spark, d)
    y, x, s = F.col("y"), F.col("x"), F.col("size")
    corner = lambda a, b: F.struct((y + s * a).alias("y"), (x + s * b).alias("x"))
    ring = F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0))
    points = boxes.select("recording", "id", (y + s / 2).alias("y"), (x + s / 2).alias("x"))
    found = points_in_regions(points, boxes.select("recording", F.col("id").alias("region"), F.array(ring).alias("rings")), ["recording"], "id", "region")
    return found.select("recording", "id", "region")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_regions, p4_found, p4_paths, p4_descendants, p4_all_descendants)} | reference.QUERIES

SQL: dict[str, str] = {
    "p2_found": f"WITH {reference._NODES} SELECT a.movie, a.node_id AS node_a, b.node_id AS node_b FROM n a JOIN n b ON a.movie = b.movie AND a.t = b.t AND a.node_id < b.node_id WHERE {reference._DIST} <= 6.5",
    "p2_regions": """WITH w AS (SELECT id, any_value(lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g'))) AS n, any_value(origin_um) AS o, any_value(size_um) AS s FROM ultrack_windows
WHERE id IS NOT NULL AND name IS NOT NULL AND size_um IS NOT NULL AND len(origin_um) = 3 AND origin_um[1] + origin_um[2] + origin_um[3] IS NOT NULL AND NOT isnan(origin_um[1] + origin_um[2] + origin_um[3]) GROUP BY id)
SELECT a.n AS recording, a.id AS id, b.id AS region FROM w a JOIN w b ON a.n = b.n WHERE b.o[2] <= a.o[2] + a.s / 2 AND a.o[2] + a.s / 2 < b.o[2] + b.s AND b.o[3] <= a.o[3] + a.s / 2 AND a.o[3] + a.s / 2 < b.o[3] + b.s""",
    "p4_found": f"WITH RECURSIVE {reference._FOREST}, {reference._comp_sql('SELECT * FROM f')} SELECT movie, node_id, root AS root_id, CASE WHEN root = -1 THEN -1 ELSE k END AS depth FROM top",
    "p4_descendants": f"WITH RECURSIVE {reference._FOREST}, {reference._comp_sql('SELECT * FROM f')} SELECT up.movie, anc AS node_id, up.node_id AS descendant FROM up JOIN top ON up.movie = top.movie AND up.node_id = top.node_id WHERE root <> -1 AND anc % 20 = 0",
} | reference.SQL
