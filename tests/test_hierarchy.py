import random

from trackweave.operators.hierarchy import best_parents, descendants, hierarchy

SCHEMA = "m string, node long, parent long"


def chains(parent):
    out = {}
    for n in set(parent) | set(parent.values()):
        path, x = [n], n
        while x in parent and len(path) <= len(parent) + 1:
            x = parent[x]
            path.append(x)
        out[n] = path[::-1] if x not in parent else None
    return out


def check(spark, parent):
    df = spark.createDataFrame([("a", c, p) for c, p in parent.items()], SCHEMA)
    rows = {r.node: r for r in hierarchy(df, ["m"], paths=True).collect()}
    want = chains(parent)
    assert set(rows) == set(want)
    short = {r.node: (r.root_id, r.depth) for r in hierarchy(df, ["m"]).collect()}
    for n, path in want.items():
        r = rows[n]
        assert short[n] == (r.root_id, r.depth)
        if path is None:
            assert (r.root_id, r.depth, r.path, r.size, r.pre) == (-1, -1, None, None, None)
        else:
            below = {x for x, p in want.items() if p and n in p}
            assert (list(r.path), r.root_id, r.depth, r.size) == (path, path[0], len(path) - 1, len(below))
            assert below == {x for x in rows if rows[x].root_id == r.root_id and rows[x].pre is not None and r.pre <= rows[x].pre < r.pre + r.size}


def test_random_forest(spark):
    rng = random.Random(3)
    check(spark, {n: rng.randrange(max(0, n - 12), n) for n in range(1, 150) if rng.random() < 0.9})


def test_long_chain_cycles_and_a_wide_node(spark):
    parent = {n: n - 1 for n in range(1, 70)} | {n: 5 for n in range(100, 150)}
    check(spark, parent | {200: 201, 201: 202, 202: 200, 203: 200, 204: 203, 300: 300, 301: 300})


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", None, 3), ("a", 4, None), (None, 5, 6)], SCHEMA).selectExpr("*", "1 as size", "2 as head")
    assert sorted((r.node, r.root_id, r.depth) for r in hierarchy(df, ["m"]).collect()) == [(1, 2, 1), (2, 2, 0)]
    assert hierarchy(df.limit(0), ["m"], paths=True).count() == 0


def test_best_parent_and_descendants(spark):
    edges = spark.createDataFrame([("a", 2, 5, None), ("a", 1, 5, None), ("a", 7, 6, 0.5), ("a", 3, 6, 0.5), ("a", 5, 6, 0.1)], "m string, s long, t long, p float")
    parents = best_parents(edges, ["m"], "s", "t", "p")
    assert sorted((r.node, r.parent) for r in parents.collect()) == [(5, 1), (6, 3)]
    tree = hierarchy(spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("a", 4, 2)], SCHEMA), ["m"], paths=True)
    asked = spark.createDataFrame([("a", 2)], "m string, node long")
    assert sorted(r.descendant for r in descendants(tree, ["m"], asked).collect()) == [3, 4]


def test_descendants_of_every_node(spark):
    from trackweave import queries

    d = "/root/testdata/sf0.001"
    paths = queries.p4_paths(spark, d).where("path is not null").select("movie", "node_id", "path").collect()
    want = sorted((r.movie, a, r.node_id) for r in paths for a in r.path[:-1])
    got = [tuple(r) for r in queries.QUERIES["p4_all_descendants"](spark, d).collect()]
    assert want and sorted(got) == want
    assert sum(a % 20 == 0 for _, a, _ in got) < len(got)
