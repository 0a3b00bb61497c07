import os

from trackweave.operators.samples import per_group, trend
from trackweave.operators.scoring import MODELS, out_of_fold
from trackweave.plans.stages import Stages


def test_scores_come_from_other_folds(spark):
    rows = [(k, k % 2, None if k % 10 == 3 else int(k % 4 < 2), float(k % 4 < 2) if k % 7 else None) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, fold int, y int, a double")
    got = {r.id: r.score for r in out_of_fold(df, ["a"], "y", "fold", 2, ["id"], "logistic").collect()}
    assert len(got) == 80 and all((got[k] > 0.5) == (a == 1) for k, _, _, a in rows if a is not None)
    alike = {r.score for r in out_of_fold(df.where("y = 1"), ["a"], "y", "fold", 2, ["id"], "logistic").collect()}
    assert alike == {1.0} and out_of_fold(df.limit(0), ["a"], "y", "fold", 2, ["id"], "logistic").count() == 0


def test_trend(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 0, 3.0), ("c", 0, 5.0), ("c", 1, None), ("c", 2, 1.0)], "k string, t int, v double")
    r = {x.k: x for x in trend(df, ["k"], "t", "v").collect()}
    assert (r["a"].slope, r["a"].draw_down, r["a"].net, r["a"].span) == (1.5, 0.0, 3.0, 2.0)
    assert (r["b"].n, r["b"].slope, r["b"].rising) == (1, 0.0, 0.0)
    assert (r["c"].slope, r["c"].draw_down, r["c"].decrease) == (-2.0, 4.0, 2.0)


def test_samples_are_the_same_in_every_run(spark):
    df = spark.range(1000).selectExpr("concat('g', id % 3) as g", "id")
    a, b = ({(r.g, r.id) for r in per_group(x, "g", "id", 20, 5).collect()} for x in (df, df.repartition(9)))
    assert a == b and len(a) == 60


def test_features_are_written_once_for_all_fits(spark):
    df = spark.createDataFrame([(k, k % 2, k % 3 % 2, float(k)) for k in range(40)], "id long, fold int, y int, a double")
    files = out_of_fold(df, ["a"], "y", "fold", 2, ["id", "y"], "logistic").inputFiles()
    assert files and all("/folds-" in f for f in files)


def test_model_query_reads_written_features_only(spark):
    from trackweave.reference_queries import QUERIES

    files = QUERIES["md_edge_lgbm"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/folds-" in f for f in files)


def test_model_query_exchanges_one_end_at_a_time(spark, monkeypatch):
    from trackweave import reference_queries as rq
    from trackweave.operators.features import evidence21

    read, write = {}, Stages.write
    monkeypatch.setattr(Stages, "write", lambda self, df, name, *more: (read.update({name: (self.root, df.inputFiles())}), write(self, df, name, *more))[1])
    rq.QUERIES["md_edge_lgbm"](spark, "/root/testdata/sf0.001")
    assert read["rows"][1] and not any("link_scores" in f or "track_edges" in f for f in read["rows"][1])
    assert not os.path.exists(read["src"][0].removeprefix("file:")) and MODELS["gbt"]().getCheckpointInterval() == -1
    rows, stages = rq._labelled(spark, "/root/testdata/sf0.001"), Stages(spark, "ends")
    a, b = evidence21(rows, rq._EVID, ("y", "is_learned"), stages), evidence21(rows, rq._EVID, ("y", "is_learned"))
    assert a.count() and not a.exceptAll(b).count() and not b.exceptAll(a).count()
    stages.close()
