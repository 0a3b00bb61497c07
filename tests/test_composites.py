"""Gap filling, track gate, support by a second model, node and pair columns, on cases worked out by hand."""

from tests.test_tracking import EDGES, NODES, edges, nodes
from trackweave.operators import features as ft
from trackweave.operators import tracks as tr

LINKS = "movie string, i long, j long, p double"


def test_filled_numbers_nodes_along_bridges(spark):
    n = nodes(spark, [(0, 1, 0), (3, 2, 6), (0, 3, 50), (2, 4, 52)])
    bridges = spark.createDataFrame([("m", 1, 2, 2, 6.0), ("m", 3, 4, 1, 2.0)], "movie string, e long, s long, gap int, d double")
    last = spark.createDataFrame([("m", 10)], "movie string, last_id long")
    new, links = tr.filled(n, bridges, last)
    assert sorted((r.node_id, r.t, r.x_um) for r in new.collect()) == [(11, 1, 51.0), (12, 1, 2.0), (13, 2, 4.0)]
    assert {(r.source_id, r.target_id) for r in links.collect()} == {(3, 11), (11, 4), (1, 12), (12, 13), (13, 2)}


def test_close_gaps_takes_most_bridges_of_shorter_gaps_first(spark):
    n = nodes(spark, [(0, 1, 0), (0, 2, 10), (2, 3, 9), (2, 4, 25), (3, 5, 1), (0, 6, 100), (3, 7, 101)])
    found = tr.close_gaps(n, edges(spark, [(1, 2)]).limit(0), max_gap=2)
    assert sorted((r.e, r.s, r.gap) for r in found.collect()) == [(1, 3, 1), (2, 4, 1), (6, 7, 2)]
    assert sorted((r.e, r.s) for r in tr.close_gaps(n, edges(spark, [(1, 2)]).limit(0)).collect()) == [(1, 3), (2, 4)]


def test_track_gate_by_band_and_mode(spark):
    rows = [(0, 1, 0), (1, 2, 0), (0, 3, 50), (1, 4, 50)]
    n, e = nodes(spark, rows), edges(spark, [(1, 2), (3, 4)])
    near, sensitive = nodes(spark, [(0, 91, 1), (1, 92, 1), (0, 93, 50)]), nodes(spark, [(0, 81, 1)])
    left = lambda sp, *band: tr.track_gate(n, e, spark.createDataFrame([("m", sp)], "movie string, spacing double"), near, sensitive, [band])
    ids = lambda sp, *band: {r.node_id for r in left(sp, *band)[0].collect()}
    assert ids(20.0, 19.7, 25.0, "v", 0.6, 4.0, 5.0) == {1, 2}  # half of the second track is supported
    assert ids(20.0, 19.7, 25.0, "or", 0.5, 4.0, 5.0) == {1, 2, 3, 4}
    assert ids(20.0, 19.7, 25.0, "and", 0.5, 4.0, 5.0) == {1, 2}
    assert ids(25.0, 19.7, 25.0, "v", 0.6, 4.0, 5.0) == {1, 2, 3, 4} == ids(None, 19.7, 25.0, "v", 0.6, 4.0, 5.0)
    assert [(r.source_id, r.target_id) for r in left(20.0, 19.7, 25.0, "v", 0.6, 4.0, 5.0)[1].collect()] == [(1, 2)]


def test_refined_keeps_supported_tracks_and_hands_scores_on(spark):
    second = nodes(spark, [(0, 1, 0), (1, 2, 1), (0, 3, 50), (1, 4, 51), (0, 5, 5)])
    first = nodes(spark, [(0, 7, 1), (0, 8, 90)]).selectExpr("*", "if(node_id = 7, 0.9, 0.5)::double as seed", "node_id::double as size")
    got = {r.node_id: (r.share, r.seed, r.size) for r in tr.refined(second, first, 6.0).collect()}
    assert got == {1: (0.5, 0.9, 7.0), 2: (0.5, 1.0, 0.0)}


def test_node_columns_of_a_fork(spark):
    n = spark.createDataFrame([("m", 0, 1, 0.0, 0.0, 0.0), ("m", 1, 2, 0.0, 0.0, 3.0), ("m", 1, 3, 0.0, 4.0, 0.0), ("m", 2, 4, 0.0, 0.0, 6.0), ("m", 2, 5, 0.0, 8.0, 0.0), ("m", 0, 6, 0.0, 0.0, 9.0)], NODES)
    links = spark.createDataFrame([("m", 1, 2, 0.8), ("m", 1, 3, 0.5), ("m", 2, 4, 0.7), ("m", 3, 5, 0.6), ("m", 6, 2, 0.9)], LINKS)
    prior = spark.createDataFrame([("m", 1, 0.5)], "movie string, node_id long, score double")
    rows = {r.node_id: r.asDict() for r in ft.node53(n, links, prior).collect()}
    assert len(rows) == 6 and all(set(ft.NODE53) <= set(r) for r in rows.values())
    want = {
        "p1": 0.8, "p2": 0.5, "p3": 0.0, "p2_over_p1": 0.625, "n_out": 2, "n_in": 0, "d1": 3.0, "d2": 4.0, "dsib": 5.0, "cos_sib": 0.0, "c1_q1": 0.9, "c1_is_mine": 0, "c2_is_mine": 1, "c1_nin": 2,
        "p1_margin_c1": 0.8 - 0.9, "p2_margin_c2": 0.5, "c1_out": 0.7, "c2_out": 0.6, "grand_div": 0, "mot_in": 0.0, "dens15": 1, "dens8": 0, "dnext15": 2, "dnext8": 2, "cnn": 0.5, "p2_x_cnn": 0.25,
        "trel": 0.0, "dsib2": 10.0, "dsib_growth": 2.0, "gc_min_p": 0.6, "dsib13": 0.0, "cos13": 0.0, "p2_rank": 1.0,
    }
    assert {k: round(rows[1][k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}
    assert rows[3]["mot_in"] == 4.0 and rows[3]["cos_turn1"] == 1.0 and rows[3]["mot_in_rel"] == 4.0 / 5.0  # frame's motions are 6 and 4
    assert rows[4]["dnext15"] == rows[4]["dens15"] + 1 and rows[4]["c1_is_mine"] == 0


def test_pair_columns(spark):
    pairs = spark.createDataFrame([("m", 1, 2, 3)], "movie string, u long, d1 long, d2 long")
    links = spark.createDataFrame([("m", 1, 2, 0.8), ("m", 6, 2, 0.4), ("m", 2, 4, 0.7), ("m", 6, 3, 0.0005)], LINKS)
    harmonic = spark.createDataFrame([("m", 1, 3, 0.25)], LINKS)
    vectors = spark.createDataFrame([("m", 1, [1.0, 0.0]), ("m", 2, [0.6, 0.8])], "movie string, node_id long, v array<double>")
    r = ft.pair_links(pairs, links, harmonic, vectors).first().asDict()
    want = {"p1": 0.8, "p2": 0.0, "r1": 1, "r2": 9, "rmax": 9, "h1": 0.0, "h2": 0.25, "io1": 0.4, "io2": 0.0005, "over1": 2.0, "over2": 0.0, "out1": 0.7, "out2": 0.0, "n1": 1, "n2": 0, "cos1": 0.6, "cos2": 0.0, "cos12": 0.0}
    assert {k: r[k] for k in want} == want and len(r) == 26


def test_flow_radius_follows_the_own_distance(spark):
    n = nodes(spark, [(0, 1, 0), (0, 2, 11), (0, 3, -11), (0, 4, 40), (1, 12, 12), (1, 13, -8), (1, 14, 42)])
    first = spark.createDataFrame([("m", 2, 12, 1.0), ("m", 3, 13, 3.0), ("m", 4, 14, 2.0)], "movie string, i long, j long, d double")
    nnd = lambda v: spark.createDataFrame([("m", 1, v)], "movie string, node_id long, nnd double")
    flow = lambda v: [(r.i, r.tis_n, r.fx) for r in ft.flow(n, nnd(v), first).collect()]
    assert flow(1.0) == flow(8.0) == [(1, 2, 2.0)] and flow(15.0) == [(1, 3, 2.0)]


def test_empty_tables_and_nulls(spark):
    n, e = nodes(spark, [(0, 1, 0)]).limit(0), spark.createDataFrame([], EDGES)
    links, prior = spark.createDataFrame([], LINKS), spark.createDataFrame([], "movie string, node_id long, score double")
    assert ft.node53(n, links, prior).count() == 0 and tr.close_gaps(n, e).count() == 0
    spacing = spark.createDataFrame([(None, 20.0)], "movie string, spacing double")
    kept, left = tr.track_gate(n, e, spacing, n, n, [(0.0, 99.0, "v", 0.5, 4.0, 4.0)])
    assert kept.count() == left.count() == 0
    assert tr.refined(n, n.selectExpr("*", "1D as seed", "1D as size")).count() == 0
    alone = nodes(spark, [(0, 1, 0)])
    assert ft.node53(alone, links, prior).select("n_out", "cnn", "dnext15").collect() == [(0, 0.0, 1)]
