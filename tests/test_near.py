import math

import numpy as np
import pytest

from trackweave.operators.near import chord, near_points, tree_pairs, unit_vectors

SCHEMA = "movie string, t int, id long, z double, y double, x double"


def brute(rows, radius):
    found = set()
    rows = [r for r in rows if not any(v is None or v != v for v in r)]
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[2] < b[2] and sum((p - q) ** 2 for p, q in zip(a[3:6], b[3:6])) <= radius**2:
                found.add((a[0], a[1], a[2], b[2]))
    return found


def got(df):
    return {(r.movie, r.t, r.node_a, r.node_b) for r in df.collect()}


def test_tree_pairs_equal_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 2, 15, 16, 17, 300):
        pts = rng.integers(0, 20, (n, 3)).astype(float)
        want = {(i, j) for i in range(n) for j in range(n) if ((pts[i] - pts[j]) ** 2).sum() <= 9}
        assert {(int(q), int(p)) for a, b, _ in tree_pairs(pts, pts, 3.0) for q, p in zip(a, b)} == want


@pytest.mark.parametrize("cap", [5, 4096])
def test_splits_and_halo_copies_lose_no_pair(spark, cap):
    rng = np.random.default_rng(1)
    rows = [("m", int(i % 2), i, *map(float, rng.integers(0, 12, 3))) for i in range(250)]
    rows += [("m", 0, 1000 + k, 3.0, 3.0, 3.0) for k in range(12)]  # copies of one place, more than a cell holds
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(near_points(df, ["movie", "t"], "id", ["z", "y", "x"], 2.0, cap=cap, batch=40)) == brute(rows, 2.0)


def test_nulls_edges_and_empty(spark):
    rows = [("m", 1, 1, 0.0, 0.0, 0.0), ("m", 1, 2, 2.0, 0.0, 0.0), ("m", 2, 3, 0.0, 0.0, 0.0), ("m", None, 4, 0.0, 0.0, 0.0), (None, 1, 5, 0.0, 0.0, 0.0),
            ("m", 1, None, 0.0, 0.0, 0.0), ("m", 1, 6, None, 0.0, 0.0), ("m", 1, 7, float("nan"), 0.0, 0.0), ("m", 1, 2, 2.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cell", "2 as home", "3 as n")
    assert got(near_points(df, ["movie", "t"], "id", ["z", "y", "x"], 2.0)) == {("m", 1, 1, 2)}  # inclusive
    assert near_points(df.limit(0), ["movie", "t"], "id", ["z", "y", "x"], 2.0).count() == 0


def test_places_on_a_sphere(spark):
    df = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.9), (3, 0.0, 178.0)], "id long, lat double, lon double").selectExpr("'e' as g", "*")
    u = unit_vectors("lat", "lon")
    df = df.select("g", "id", u[0].alias("a"), u[1].alias("b"), u[2].alias("c"))
    found = near_points(df, ["g"], "id", ["a", "b", "c"], chord(30.0, 6371.0)).collect()
    assert [(r.node_a, r.node_b) for r in found] == [(1, 2)] and math.isclose(found[0].distance * 6371, 22.24, abs_tol=0.01)
