"""Unmixing of a mix with more equal outputs than six."""

from utxolens.operators import evidence


def test_mix_of_eight_equal_outputs(spark):
    candidates = spark.createDataFrame([(1, 1 << i, -1) for i in range(8)] + [(2, 1 << i, i) for i in range(2)], "txid long, mask int, change_vout long")
    mixes = spark.createDataFrame([(1, 8), (2, 2), (3, 9)], "txid long, equal_outputs long")
    got = {r["txid"]: (r["solutions"], r["verdict"]) for r in evidence.unmix_partitions(candidates, mixes).collect()}
    assert got == {1: (1, "unique"), 2: (1, "unique"), 3: (0, "unsolved")}
