import random

import duckdb

import __spark_entry__
from tests.test_entry import DATA, TABLES
from tests.test_tracking import edges, nodes
from trackweave import reference_queries as ref
from trackweave.operators import tracks as tr
from trackweave.operators.components import connected


def test_all_edges_link_merges_and_cycles(spark):
    n = nodes(spark, [(k, k, k) for k in range(1, 10)])
    e = edges(spark, [(1, 3), (2, 3, 0.5), (4, 5), (5, 6), (6, 4), (6, 7)])
    assert {r.node_id: (r.comp, r.n) for r in tr.components(n, e).collect()} == dict.fromkeys((1, 2, 3), (1, 3)) | dict.fromkeys((4, 5, 6, 7), (4, 4)) | {8: (8, 1), 9: (9, 1)}
    assert {r.node_id for r in tr.long_tracks(n, e, 3, keep_divisions=False).collect()} == set(range(1, 8))


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(190)] + [(k, k + 1) for k in range(1000, 1100)] + [(3000, k) for k in range(2000, 2050)]
    label = {v: v for p in pairs for v in p}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    linked = {v for p in pairs if p[0] != p[1] for v in p}
    found = connected(edges(spark, pairs), ["movie"], "source_id", "target_id").collect()
    assert {r.node: r.comp for r in found} == {v: label[v] for v in linked} and len(found) == len(linked)


def test_nodes_of_a_cyclic_chain_are_segments_of_their_own(spark):
    n = nodes(spark, [(k, k, k) for k in range(1, 7)])
    e = edges(spark, [(1, 2), (2, 1), (3, 4), (4, 3), (5, 6)])
    assert {r.node_id: r.segment for r in tr.segments(n, e).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}


def test_query_equals_a_recursion_over_undirected_edges(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    said = con.execute(f"""WITH RECURSIVE {ref._NODES}, {ref._EDGES}, u AS (SELECT movie, source_id AS a, target_id AS b FROM e UNION SELECT movie, target_id, source_id FROM e),
r AS (SELECT movie, a AS node_id, a AS k FROM u UNION SELECT r.movie, b, k FROM r JOIN u ON r.movie = u.movie AND r.node_id = u.a), c AS (SELECT movie, node_id, min(k) AS comp FROM r GROUP BY ALL),
cc AS (SELECT n.movie, n.node_id, coalesce(comp, n.node_id) AS comp FROM n LEFT JOIN c ON n.movie = c.movie AND n.node_id = c.node_id) SELECT movie, node_id, comp, count(*) OVER (PARTITION BY movie, comp) AS n FROM cc""").fetchall()
    found = __spark_entry__.queries()["gr_components"](spark, DATA)
    assert sorted(tuple(r) for r in found.select("movie", "node_id", "comp", "n").collect()) == sorted(said)
