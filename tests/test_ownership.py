"""Common-input clusters: micro-cases, and daily updates against a full run."""

import random

from utxolens.operators import ownership as O

POOL = "pool_id string, address string, kind string"
SPENDS = "pool_id string, txid long, n_in long, inputs array<string>, is_mix boolean"


def test_mixes_prove_nothing(spark):
    pool = spark.createDataFrame([("p", a, "segwit") for a in "abcd"] + [("q", "a", "segwit"), ("q", "c", None)], POOL)
    txi = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "c"), (3, "c"), (3, "x"), (4, None), (4, "d"), (5, "c"), (5, "d")], "txid long, address string")
    txo = spark.createDataFrame([(1, 70), (2, 9), (2, 9), (2, 9), (3, 5), (5, 500000), (5, 500000)], "txid long, value_sats long")
    found = O.common_spends(pool, txi, txo)
    assert {(r["pool_id"], r["txid"], r["n_in"], tuple(r["inputs"]), r["is_mix"]) for r in found.collect()} == {
        ("p", 1, 3, ("a", "b"), False), ("p", 2, 2, ("b", "c"), True), ("p", 5, 2, ("c", "d"), True),
    }
    labels = O.clusters(pool, found)
    assert {(r["pool_id"], r["address"], r["cluster"]) for r in labels.collect()} == {("p", "a", "a"), ("p", "b", "a"), ("p", "c", "c"), ("p", "d", "d"), ("q", "a", "a"), ("q", "c", "c")}
    report = {r["pool_id"]: r for r in O.pool_report(pool, found, labels).collect()}
    assert (report["p"]["groups"], report["p"]["largest"], report["p"]["mixes"], report["p"]["confidence"]) == (3, 2, 2, 50 + 15 + 4 + 3)
    assert (report["q"]["kind"], report["q"]["spends"], report["q"]["confidence"]) == (None, 0, 30)


def test_a_crowd_of_inputs_is_a_mix(spark):
    pool = spark.createDataFrame([("p", a, None) for a in "abc"], POOL)
    txi = spark.createDataFrame([(t, a) for t in (1, 2) for a in ("abcxy" if t == 1 else "abcx")], "txid long, address string")
    txo = spark.createDataFrame([(t, s) for t in (1, 2) for s in (100, 101)], "txid long, value_sats long")
    assert {r["txid"]: r["is_mix"] for r in O.common_spends(pool, txi, txo).collect()} == {1: True, 2: False}


def test_nothing_spent(spark):
    pool = spark.createDataFrame([("p", "a", None)], POOL)
    none = spark.createDataFrame([], SPENDS)
    labels = O.clusters(pool, none)
    assert [tuple(r) for r in labels.collect()] == [("p", "a", "a")]
    assert [tuple(r) for r in O.update_clusters(labels, none).collect()] == [("p", "a", "a", False)]


def test_ten_batches_equal_a_full_run(spark):
    draw = random.Random(7)
    names = [f"a{i:03d}" for i in range(240)]
    batches = [[("pq"[draw.random() < 0.3], 100 * b + i, 2, sorted(draw.sample(names, draw.choice((2, 2, 3)))), draw.random() < 0.1) for i in range(14)] for b in range(10)]
    labels, moved = spark.createDataFrame([], "pool_id string, address string, cluster string"), 0
    for batch in batches:
        now = O.update_clusters(labels, spark.createDataFrame(batch, SPENDS))
        rows = now.collect()
        before = {(r["pool_id"], r["address"]): r["cluster"] for r in labels.collect()}
        assert all(r["moved"] == (before.get((r["pool_id"], r["address"])) != r["cluster"]) for r in rows)
        moved += sum(r["moved"] for r in rows)
        labels = spark.createDataFrame([(r["pool_id"], r["address"], r["cluster"]) for r in rows], "pool_id string, address string, cluster string")
    everything = spark.createDataFrame([s for b in batches for s in b], SPENDS)
    pool = labels.select("pool_id", "address")
    assert set(map(tuple, labels.collect())) == set(map(tuple, O.clusters(pool, everything).collect()))
    assert moved < 10 * labels.count()
