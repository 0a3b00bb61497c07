import random

from trackweave.operators import tracks as tr

PAIRS = "movie string, e long, s long, gap int, d double"


def greedy(rows):
    es, ss, out = set(), set(), []
    for m, e, s, gap, d in sorted(rows, key=lambda r: (r[3], r[4], r[1], r[2])):
        if e not in es and s not in ss:
            es.add(e)
            ss.add(s)
            out.append((m, e, s, gap, d))
    return sorted(out)


def test_bridges_of_a_pile_are_all_found_in_one_round(spark):
    rows = [("m", e, 1000 + s, 1, 2.0) for e in range(150) for s in range(140)]
    rows += [("m", 0, 5000, 1, 3.0), ("m", 149, 5000, 1, 2.5), ("m", 148, 5001, 2, 0.5)]
    found = tr.bridges(spark.createDataFrame(rows, PAIRS))
    assert sorted(tuple(r) for r in found.select("movie", "e", "s", "gap", "d").collect()) == greedy(rows)
    assert len(found.inputFiles()) and len({f.split("/")[-2] for f in found.inputFiles()}) <= 4


def test_bridges_equal_a_sorted_pass(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):  # small cases of many ties, piles and pieces of piles beside each other
        ends, starts = ([rng.randrange(3) for _ in range(rng.randrange(1, 6))] for _ in range(2))
        rows += [("m", 100 * k + e, 100 * k + s, 1, float(abs(a - b))) for e, a in enumerate(ends) for s, b in enumerate(starts) if a != 2 or rng.random() < 0.8]
    found = tr.bridges(spark.createDataFrame(rows, PAIRS))
    assert sorted(tuple(r) for r in found.select("movie", "e", "s", "gap", "d").collect()) == greedy(rows)
