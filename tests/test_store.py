"""The versioned store: latest wins, half a write is never seen, equal buckets are never read."""

import shutil
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from utxolens.sources import imports as I
from utxolens.sources import store as S

ROW = "id string, a long, b string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), ROW)


def held(spark, path, number=None):
    return {tuple(r[c] for c in ("id", "a", "b")) for r in S.read(spark, path, number).collect()}


def test_latest_wins_and_old_versions_stay(spark, tmp_path):
    path = str(tmp_path / "s")
    assert S.version(spark, path) is None
    assert S.upsert(rows(spark, ("x", 1, "p"), ("x", 2, "p"), ("y", 5, None), (None, 3, "n")), path, ["id"], ["a"]) == 1
    assert held(spark, path) == {("x", 2, "p"), ("y", 5, None), (None, 3, "n")}
    gone = spark.createDataFrame([("y",), ("x",), ("q",)], "id string")
    assert S.upsert(rows(spark, ("x", 9, None), (None, 4, "m")), path, ["id"], gone=gone) == 2
    assert held(spark, path) == {("x", 9, None), (None, 4, "m")}
    assert held(spark, path, 1) == {("x", 2, "p"), ("y", 5, None), (None, 3, "n")}
    assert S.upsert(rows(spark).limit(0), path, ["id"]) == 3
    assert held(spark, path) == held(spark, path, 2)
    with pytest.raises(ValueError):
        S.upsert(rows(spark).drop("b"), path, ["id"])
    with pytest.raises(ValueError):
        S.read(spark, path, 7)


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "s")
    S.upsert(rows(spark, ("x", 1, "p"), ("y", 2, "q")), path, ["id"])
    before = held(spark, path)
    bad = rows(spark, ("x", 5, "p")).withColumn("a", F.when(F.col("a") == 5, F.raise_error(F.lit("killed")).cast("long")))
    with pytest.raises(PySparkException):
        S.upsert(bad, path, ["id"])
    S.upsert(rows(spark, ("x", 7, "r")), path, ["id"])
    (Path(path) / "commits/version=2/_SUCCESS").unlink()
    assert S.versions(spark, path) == [1] and held(spark, path) == before
    shutil.rmtree(Path(path) / "commits/version=2")
    assert S.upsert(rows(spark, ("y", 8, "r")), path, ["id"]) == 2
    assert held(spark, path) == {("x", 1, "p"), ("y", 8, "r")}


def test_equal_buckets_are_not_read(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    first = [(f"k{i}", i, None if i % 3 else "v") for i in range(200)]
    S.upsert(rows(spark, *first), a, ["id"], of=16)
    S.upsert(rows(spark, *first[::-1]), b, ["id"], of=16)
    assert S.differences(spark, a, 1, b, 1)[1:] == (200, [])
    S.upsert(rows(spark, ("k5", None, "5")), b, ["id"])
    bucket = S.differences(spark, a, 1, b, 2)[2]
    assert len(bucket) == 1
    for f in Path(a).glob("data/*/bucket=*"):
        if f.name != f"bucket={bucket[0]}":
            shutil.rmtree(f)
    changes, same, _ = S.differences(spark, a, 1, b, 2)
    assert [(r["id"]) for r in changes.filter("change = 'changed'").collect()] == ["k5"]
    assert {r["change"]: r["n"] for r in S.change_counts(spark, a, 1, b, 2).collect()} == {"changed": 1, "unchanged": 199} and 0 < same < 199


def test_values_that_move_beside_a_null_are_changes(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    pair = "id string, a string, b string"
    S.upsert(spark.createDataFrame([("x", None, "5"), ("y", "1", "1"), (None, "1", "1")], pair), a, ["id"])
    S.upsert(spark.createDataFrame([("x", "5", None), ("z", "1", "1"), (None, "1", "1")], pair), b, ["id"])
    assert {r["change"]: r["n"] for r in S.change_counts(spark, a, 1, b, 1).collect()} == {"changed": 1, "added": 1, "removed": 1, "unchanged": 1}


def test_cases_merge(spark, tmp_path):
    path, case = str(tmp_path / "s"), "id string, nodes array<string>, links array<string>, title string"
    one = spark.createDataFrame([("a", ["1"], [], "first"), ("b", ["1"], [], "first"), (None, [], [], "x"), ("", [], [], "x"), ("c", None, [], "x")], case)
    assert I.merge_cases(one, path) == (1, 3)
    assert I.merge_cases(spark.createDataFrame([("a", ["2"], [], "second"), ("b", ["2"], None, "second")], case), path) == (2, 1)
    assert {(r["id"], r["title"]) for r in S.read(spark, path).collect()} == {("a", "second"), ("b", "first")}
    assert I.merge_cases(spark.createDataFrame([("d", [], [], "third")], case), path, replace=True)[1] == 0
    assert [r["id"] for r in S.read(spark, path).collect()] == ["d"]
    assert I.merge_cases(spark.createDataFrame([("e", None, [], "bad")], case), path, replace=True)[1] == 1
    assert [r["id"] for r in S.read(spark, path).collect()] == ["d"]


def test_a_first_version_is_written_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "settled", lambda df: 1 / 0)  # nothing to compare with, nothing to keep
    path = str(tmp_path / "first")
    assert S.upsert(spark.createDataFrame([("x", 1), ("x", 3), (None, 2), ("y", 4)], "id string, a long"), path, ["id"], ["a"], of=32) == 1
    assert sorted(map(tuple, S.read(spark, path).select("id", "a").collect()), key=str) == [("x", 3), ("y", 4), (None, 2)] and S.version(spark, path).of == 32
