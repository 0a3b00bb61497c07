import random

from trackweave.operators.regions import points_in_regions

SCHEMA = "m string, region string, rings array<array<struct<y:double,x:double>>>"


def inside(y, x, rings):
    odd = False
    for ring in rings:
        for (ya, xa), (yb, xb) in zip(ring, ring[1:] + ring[:1]):
            if ya > yb:
                ya, xa, yb, xb = yb, xb, ya, xa
            if ya <= y < yb and x < xa + (y - ya) * ((xb - xa) / (yb - ya)):
                odd = not odd
    return odd


def test_points_in_polygons_with_holes_equal_brute_force(spark):
    rng = random.Random(5)
    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    regions = {"square": [square], "next": [[(0.0, 10.0), (0.0, 20.0), (10.0, 20.0), (10.0, 10.0)]], "hole": [square, [(4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0)]], "line": [[(1.0, 1.0), (2.0, 2.0)]]}
    for k in range(6):
        regions[f"r{k}"] = [[(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(rng.randrange(3, 8))]]
    places = [(rng.uniform(-1, 21), rng.uniform(-1, 21)) for _ in range(400)] + [(float(a), float(b)) for a in (0, 4, 5, 6, 10) for b in (0, 4, 5, 6, 10, 20)]
    p = spark.createDataFrame([("a", k, y, x, 1) for k, (y, x) in enumerate(places)] + [("b", 1, 5.0, 5.0, 1), ("a", 0, *places[0], 1), ("a", None, 5.0, 5.0, 1), ("a", 900, None, 5.0, 1)], "m string, id long, y double, x double, region int")
    r = spark.createDataFrame([("a", n, rings) for n, rings in regions.items()] + [("a", None, [square]), ("a", "null", None), ("a", "gap", [[(0.0, 0.0), (None, 1.0), (5.0, 5.0)]])], SCHEMA)
    want = {("a", k, n) for k, (y, x) in enumerate(places) for n, rings in regions.items() if n != "line" and inside(y, x, rings)}
    for cap in (20_000, 40):
        rows = [tuple(x) for x in points_in_regions(p, r, ["m"], "id", "region", cap).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert points_in_regions(p.limit(0), r, ["m"], "id", "region").count() == 0 and points_in_regions(p, r.limit(0), ["m"], "id", "region").count() == 0
