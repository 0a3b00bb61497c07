import hashlib
import json

import pytest

from trackweave.sources import files


def test_submission_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, "m", "node", 1, 0, 2, 3, 4, -1, -1), (1, "m", "edge", -1, -1, -1, -1, -1, 1, 2)], files.SUBMISSION)
    files.write_submission(rows, str(tmp_path / "s"))
    nodes, edges = files.read_submission(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in nodes.collect()] == [("m", 1, 0, 2, 3, 4)] and [tuple(r) for r in edges.collect()] == [("m", 1, 2)]


def test_only_named_movies_are_replaced(spark, tmp_path):
    files.write_by_movie(spark.createDataFrame([("a", 1), ("b", 2)], "movie string, v int"), str(tmp_path / "t"))
    files.write_by_movie(spark.createDataFrame([("b", 3)], "movie string, v int"), str(tmp_path / "t"))
    assert sorted((r.movie, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 1), ("b", 3)]


HEAD = "volume,frame,mother_z,mother_y,mother_x,d1_z,d1_y,d1_x,d2_z,d2_y,d2_x,sister_um,verdict\n"


def test_hand_labels(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text(HEAD + "v,1,0,0,0,0,0,0,0,0,10,4.1,1\nv,1,0,0,0,0,0,10,0,0,0,4.1,1\nv,2,0,0,0,0,0,0,0,0,10,4.1,\n")
    assert [(r.frame, r.verdict) for r in files.read_hand_labels(spark, str(p)).collect()] == [(1, 1)]
    for bad in ("v,1,0,0,0,0,0,0,0,0,10,4.1,1\nv,1,0,0,0,0,0,10,0,0,0,4.1,0\n", "v,1,0,0,0,0,0,0,0,0,10,10,1\n"):
        p.write_text(HEAD + bad)
        with pytest.raises(Exception, match="conflicting|not in um"):
            files.read_hand_labels(spark, str(p)).collect()


def test_json_and_checksums(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"name": "p", "train": ["a"], "test": ["b", "c"]}]))
    assert files.read_splits(spark, str(tmp_path / "s.json")).count() == 3
    (tmp_path / "f.json").write_text(json.dumps({"note": "x", "fold0": ["a", "b"], "fold1": []}))
    assert sorted(tuple(r) for r in files.read_folds(spark, str(tmp_path / "f.json")).collect()) == [("fold0", "a"), ("fold0", "b")]
    d = tmp_path / "d"
    d.mkdir()
    (d / "one").write_bytes(b"1")
    (d / "two").write_bytes(b"2")
    (tmp_path / "m").write_text(f"{hashlib.sha256(b'1').hexdigest()}  d/one\n{hashlib.sha256(b'x').hexdigest()}  d/two\n{'0' * 64}  d/three\n")
    assert sorted(r.path for r in files.mismatched(spark, str(d), str(tmp_path / "m")).collect()) == ["three", "two"]


def test_bands():
    assert files.parse_bands("19.7:25:or:0.4:4:5;25:99:and:0.2:5:5")[1] == (25.0, 99.0, "and", 0.2, 5.0, 5.0)
    with pytest.raises(ValueError):
        files.parse_bands("1:2:xor:0:1:1")
