"""Queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import groups, leaks, spam, splits, tokens, topn
from trackweave.reference_queries import _EDGES, _SCORES
from trackweave.sources.tables import current_scores, known_nodes, table, valid_edges

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return valid_edges(table(spark, d, "track_edges"), table(spark, d, "track_nodes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every known node in a group of at least two, with the smallest node_id of the group."""
    found = groups.connected_groups(_edges(spark, d), ["movie"], "source_id", "target_id")
    return found.select("movie", F.col("node").alias("node_id"), "group_id")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every known node with its group; a node linked with no other is its own."""
    known = known_nodes(table(spark, d, "track_nodes"))
    return known.join(p1_found(spark, d), ["movie", "node_id"], "left").select("movie", "node_id", F.coalesce("group_id", "node_id").alias("group_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Test windows that belong together with a train window of the same plan."""
    return splits.broken_plans(table(spark, d, "splits"), splits.related_windows(table(spark, d, "ultrack_windows")))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    """The windows of every plan dealt anew in its shares, related windows together."""
    return splits.planned(table(spark, d, "splits"), splits.related_windows(table(spark, d, "ultrack_windows")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The three links with the highest p of every source node and evidence source."""
    rows = table(spark, d, "link_scores").where("movie is not null and source is not null and i <> -1 and j <> -1")
    cur = current_scores(rows, ["movie", "source", "i", "j"], "scored_at", "p")
    return topn.top_n(cur, ["movie", "source", "i"], "p", "j", 3, scores=rows).select("movie", "source", "i", "j")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every text by byte_bpe_50k."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain at least 12 consecutive words of an evaluation item."""
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents at least half of whose words are keywords, links, tags or product lines."""
    return spam.stuffed(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_split, p5_found, p6_ids, p7_found, p8_found)
}

_REACHED = f"""{_EDGES}, k AS (SELECT DISTINCT movie, node_id FROM track_nodes WHERE movie IS NOT NULL AND node_id IS NOT NULL),
u AS (SELECT movie, source_id AS a, target_id AS b FROM e WHERE source_id <> target_id UNION SELECT movie, target_id, source_id FROM e WHERE source_id <> target_id),
r AS (SELECT DISTINCT movie, a AS node_id, a AS other FROM u UNION SELECT r.movie, u.b, r.other FROM r JOIN u ON r.movie = u.movie AND r.node_id = u.a),
g AS (SELECT movie, node_id, min(other) AS group_id FROM r GROUP BY ALL)"""
_RELATED = """w AS (SELECT id, any_value(lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g'))) AS n, any_value(origin_um) AS o, any_value(size_um) AS s, any_value(t0) AS t0, any_value(t0 + stride * (n_frames - 1)) AS t1 FROM ultrack_windows GROUP BY id),
v AS (SELECT * FROM w WHERE n IS NOT NULL AND s IS NOT NULL AND len(o) = 3 AND o[1] + o[2] + o[3] IS NOT NULL AND NOT isnan(o[1] + o[2] + o[3])),
u AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.n = b.n AND a.t0 <= b.t1 AND b.t0 <= a.t1 AND a.o[1] < b.o[1] + b.s AND b.o[1] < a.o[1] + a.s AND a.o[2] < b.o[2] + b.s AND b.o[2] < a.o[2] + a.s AND a.o[3] < b.o[3] + b.s AND b.o[3] < a.o[3] + a.s),
r AS (SELECT id, id AS other FROM w UNION SELECT u.b, r.other FROM r JOIN u ON r.id = u.a),
c AS (SELECT id, min(other) AS component FROM r GROUP BY id),
l AS (SELECT name, 'train' AS side, unnest(train) AS id FROM splits UNION SELECT name, 'test', unnest(test) FROM splits), m AS (SELECT DISTINCT name, side, l.id, component FROM l JOIN c ON l.id = c.id)"""

SQL: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {_REACHED} SELECT * FROM g",
    "p1_groups": f"WITH RECURSIVE {_REACHED} SELECT k.movie, k.node_id, coalesce(group_id, k.node_id) AS group_id FROM k LEFT JOIN g ON k.movie = g.movie AND k.node_id = g.node_id",
    "p3_found": f"WITH RECURSIVE {_RELATED} SELECT name AS split_name, id AS window_id FROM m WHERE side = 'test' AND (name, component) IN (SELECT (name, component) FROM m WHERE side = 'train')",
    "p5_found": f"WITH {_SCORES} SELECT movie, source, i, j FROM (SELECT *, row_number() OVER (PARTITION BY movie, source, i ORDER BY p DESC, j) AS r FROM s) WHERE r <= 3",
}
