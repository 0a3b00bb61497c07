import __spark_entry__
from tests.test_entry import DATA
from trackweave.operators import links as lk


def test_strongest_counts_by_frame(spark):
    rows = [("m", "a", t, i, 0, float(i)) for t in (0, 1, None) for i in range(5)] + [("m", "b", 0, 9, 0, 0.0)]
    found = lk.strongest(spark.createDataFrame(rows, "movie string, source string, t int, i long, j long, p double"), 3).collect()
    assert sorted((r.source, -1 if r.t is None else r.t, r.i) for r in found) == sorted([("a", t, i) for t in (0, 1) for i in (2, 3, 4)] + [("a", -1, i) for i in range(5)] + [("b", 0, 9)])


def test_peaks_keep_all_links_below_the_bound(spark):
    q = __spark_entry__.queries()["so_max_peaks"](spark, DATA)
    rows = q.groupBy("movie", "source").count().collect()
    assert max(r["count"] for r in rows) > 40
