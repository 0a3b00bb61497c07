import itertools

import numpy as np
import pandas as pd

from trackweave.operators import links as lk
from trackweave.operators import matching as mt
from trackweave.operators import spatial as sp
from trackweave.operators import tracks as tr

NODES = "movie string, t int, node_id long, z_um double, y_um double, x_um double"
EDGES = "movie string, source_id long, target_id long, p float"


def nodes(spark, rows):
    return spark.createDataFrame([("m", t, i, 0.0, 0.0, float(x)) for t, i, x in rows], NODES)


def edges(spark, rows):
    return spark.createDataFrame([("m", a, b, 1.0 if len(r) == 0 else r[0]) for a, b, *r in rows], EDGES)


def test_matching_is_largest_then_shortest():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n, m = rng.integers(1, 6, 2)
        pairs = pd.DataFrame([(i, j, float(rng.integers(1, 9))) for i in range(n) for j in range(m) if rng.random() < 0.6], columns=["i", "j", "d"])
        if not len(pairs):
            continue
        best = (0, 0.0)
        for k in range(min(n, m), 0, -1):
            sums = [sum(pairs.d[list(c)]) for c in itertools.combinations(range(len(pairs)), k) if pairs.i[list(c)].is_unique and pairs.j[list(c)].is_unique]
            if sums:
                best = (k, min(sums))
                break
        found = pairs.iloc[mt.gated(pairs)]
        assert found.i.is_unique and found.j.is_unique and (len(found), found.d.sum()) == best


def test_cardinality_comes_first(spark):
    n = nodes(spark, [(0, 1, 0), (0, 2, 6), (1, 3, 5), (1, 4, 11.5)])
    found = mt.link_frames(n, 7.0, None).collect()
    assert sorted((r.i, r.j, r.d) for r in found) == [(1, 3, 5.0), (2, 4, 5.5)]


def test_second_child_once_and_only_if_alike(spark):
    n = spark.createDataFrame([("m", 0, 1, 0.0, 0.0, 0.0), ("m", 1, 2, 0.0, 0.0, 3.0), ("m", 1, 3, 0.0, 0.0, -3.5), ("m", 1, 4, 0.0, 0.0, 6.0)], NODES)
    assert sorted((r.i, r.j, r.second) for r in mt.link_frames(n).collect()) == [(1, 2, False), (1, 3, True)]
    far = nodes(spark, [(0, 1, 0), (1, 2, 1), (1, 3, 4)])
    assert [(r.i, r.j) for r in mt.link_frames(far).collect()] == [(1, 2)]


def test_radius_is_inclusive_and_cells_lose_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [("m", int(k % 2), k, *map(float, rng.integers(-9, 9, 3))) for k in range(120)]
    want = {(a[2], b[2]) for a in rows for b in rows if b[1] == a[1] + 1 and sum((p - q) ** 2 for p, q in zip(a[3:], b[3:])) <= 25}
    df = spark.createDataFrame(rows, NODES)
    assert {(r.i, r.j) for r in sp.next_frame_pairs(df, 5.0).collect()} == want
    near = sp.next_frame_nearest(df, 3, "i", first=1.0).collect()
    for i in {r[2] for r in rows if r[1] == 0}:
        a = next(r for r in rows if r[2] == i)
        order = sorted((sum((p - q) ** 2 for p, q in zip(a[3:], b[3:])), b[2]) for b in rows if b[1] == 1)
        assert {r.j for r in near if r.i == i} == {j for _, j in order[:3]}


def test_greedy_suppression(spark):
    n = nodes(spark, [(0, 1, 0), (0, 2, 3), (0, 3, 6)]).selectExpr("*", "1 - node_id * 0.1 as score")
    assert sorted(r.node_id for r in tr.spaced(n, 4.0, "score").collect()) == [1, 3]


def test_segments_forks_and_components(spark):
    n = nodes(spark, [(k, k, k) for k in range(1, 7)])
    e = edges(spark, [(1, 2), (2, 3, 0.4), (2, 4, 0.6), (4, 5)])
    assert {frozenset(r.node_id for r in tr.segments(n, e).collect() if r.segment == s) for s in (1, 3, 4, 6)} == {frozenset({1, 2}), frozenset({3}), frozenset({4, 5}), frozenset({6})}
    assert [(r.u, r.d1, r.d2) for r in tr.forks(e).collect()] == [(2, 4, 3)]
    assert {r.node_id: (r.comp, r.n) for r in tr.components(n, e).collect()} == {k: (1, 5) for k in range(1, 6)} | {6: (6, 1)}
    assert {r.node_id for r in tr.long_tracks(n, e, 6).collect()} == {1, 2, 3, 4, 5}
    assert {r.node_id for r in tr.long_tracks(n, e, 6, keep_divisions=False).collect()} == set()


def test_gaps(spark):
    track = [(t, t, 0) for t in range(4)] + [(t, t, 4) for t in range(5, 9)]
    e = edges(spark, [(k, k + 1) for k in (0, 1, 2, 5, 6, 7)])
    found = tr.gap_pairs(nodes(spark, track), e)
    assert [(r.e, r.s, r.gap, r.d) for r in found.collect()] == [(3, 5, 1, 4.0)]
    assert [(r.e, r.s) for r in tr.bridges(found).collect()] == [(3, 5)]
    assert tr.gap_pairs(nodes(spark, [*track, (4, 99, 1.5)]), e).count() == 0  # a node in the way


def test_line_fit(spark):
    n = nodes(spark, [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 10)])
    e = edges(spark, [(0, 1), (1, 2), (2, 3)])
    x = {r.node_id: r.x for r in tr.smoothed(n, e).collect()}
    assert abs(x[0] + 1.12) < 1e-9


def test_velocity_needs_eight_edges(spark):
    rows = [(0, k, 10 * k) for k in range(9)] + [(1, 100 + k, 10 * k + 1) for k in range(9)] + [(2, 200 + k, 10 * k + 5) for k in range(7)]
    e = edges(spark, [(k, 100 + k) for k in range(9)] + [(100 + k, 200 + k) for k in range(7)])
    v = {r.t: r.vx for r in tr.frame_velocity(nodes(spark, rows), e).collect()}
    assert v == {0: 0.0, 1: 1.0, 2: 0.0}
    assert {r.t: r.sx for r in tr.drift(tr.frame_velocity(nodes(spark, rows), e)).collect()} == {0: 0.0, 1: 1.0, 2: 1.0}


def test_top_links_pad_and_softmax_scope(spark):
    one = spark.createDataFrame([("m", 1, 2, 0.7)], "movie string, i long, j long, p double")
    r = lk.top_links(one).first()
    assert (r.p1, r.p2, r.c1, r.c2, r.degree) == (0.7, 0.0, 2, -1, 1)
    two = spark.createDataFrame([("m", 1, 9, 0.0), ("m", 2, 9, 0.0)], "movie string, i long, j long, l double")
    r = lk.two_way_probabilities(two, "l").collect()
    assert [(x.fwd, x.rev, x.harm) for x in r] == [(0.5, 1.0, 0.5)] * 2


def test_percent_ranks_break_ties_by_id(spark):
    df = spark.createDataFrame([("m", 1, 0.1), ("m", 2, 0.1), ("m", 3, 0.9)], "movie string, node_id long, v double")
    assert [r.pct for r in lk.percent_ranks(df, ["movie"], "v", "node_id").orderBy("node_id").collect()] == [0.0, 0.5, 1.0]


def test_empty_tables(spark):
    n, e = nodes(spark, [(0, 1, 0)]).limit(0), edges(spark, [(1, 2)]).limit(0)
    for df in (sp.candidates(n), sp.nearest_in_frame(n), mt.link_frames(n), tr.segments(n, e), tr.spaced(n.selectExpr("*", "1.0 as s"), 4.0, "s"), tr.smoothed(n, e), tr.bridges(tr.gap_pairs(n, e))):
        assert df.count() == 0


def test_edge_columns_leave_only_their_own_tables(spark):
    from trackweave.operators.features import edge47
    from trackweave.plans import stages

    before = list(stages._open)
    nodes = spark.createDataFrame([("m", k, k // 3, 1.0, 9.0 * (k % 3), 0.5 * k) for k in range(12)], "movie string, node_id long, t int, z_um double, y_um double, x_um double")
    links = spark.createDataFrame([("m", k, k + 3, 1.5) for k in range(9)], "movie string, i long, j long, d double")
    evidence = spark.createDataFrame([("m", 0, 3, 0.5, None), ("m", 7, 7, 1.0, 1.0)], "movie string, i long, j long, a float, b float")
    rows = {r.i: r for r in edge47(nodes, links, evidence, ["a", "b"]).collect()}
    assert len(rows) == 9 and rows[0].a == rows[0].spread == 0.5 and rows[1].a == rows[0].b == 0.0 and rows[0].tis_n == 2  # both others of the frame lie within 27 um
    assert {s.root.rpartition("/")[2].partition("-")[0] for s in stages._open if s not in before} == {"edge26", "edge47"}
    assert all("geometry" not in p for s in stages._open if s not in before for p in s.paths)
