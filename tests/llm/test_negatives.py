"""Hard negatives against brute force: ties, nulls, lengths, repeated rows, blocks of all sizes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from utxolens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor string"


def by_hand(rows, every, positives=5, wanted=10, low=30, high=90):
    ok = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, y, v in ok:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in ok if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            inside = [(-t, k) for t, k, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:wanted]
            out += [(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(inside)]
    return sorted(out)


def some_rows(n=140, dim=5, seed=4):
    dice = random.Random(seed)
    rows = [(i, [dice.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.75]) for _ in range(dim)], dice.choice([0, 0, 0, 1, 2])) for i in range(n)]
    rows += [(200, [0.0] * dim, 0), (201, [0.0] * dim, 0), (202, [0.0] * dim, 1), (203, None, 1), (None, [1.0] * dim, 1), (204, [1.0] * dim, None), (205, [None] * dim, 1), (206, [float("nan")] * dim, 1), (207, [float("inf")] * dim, 1)]
    rows += [(210, [0.5, 0.5], 0), (220, [0.5, 0.25], 0), (230, [0.5, 0.1], 1), (240, [], 0), (250, [], 1), rows[0], rows[0], rows[10]]
    return rows + [(20, [0.25] * dim, 2)]  # another row of an id that is there


def made(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "x") for i, v, y in rows], SCHEMA)


@pytest.mark.parametrize("block_rows, per_block", [(8192, 256), (7, 3)])
def test_against_brute_force(spark, block_rows, per_block):
    rows = some_rows()
    got = negatives.mined(made(spark, rows), F.col("vec_id") % 10 == 0, block_rows=block_rows, per_block=per_block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = by_hand(rows, 10)
    assert sorted(map(tuple, got.collect())) == want and any(r[4] == 0 for r in want)


def test_nothing_to_mine(spark):
    frame = made(spark, some_rows(20))
    for own, anchors in ((frame.limit(0), F.lit(True)), (frame, F.lit(False)), (frame.filter("label = 0"), F.lit(True)), (frame, F.lit(None).cast("boolean"))):
        assert negatives.mined(own, anchors).collect() == []


def test_keys_sort_as_scores_do():
    dice = random.Random(2)
    rows = [(dice.choice([-3, 0, 5]), dice.choice([-(1 << 60), -7, 0, 7, 1 << 60]), dice.randint(0, 1), dice.randint(-5, 5)) for _ in range(500)]
    assert [negatives.unpacked(k) for k in sorted(negatives.packed(*r) for r in rows)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_windows_open_and_close():
    keys = [negatives.packed(1, 100, 0, 7), negatives.packed(1, 95, 1, 8), negatives.packed(1, 90, 1, 9), negatives.packed(1, 50, 0, 10), negatives.packed(1, 45, 1, 11), negatives.packed(1, 29, 1, 12), negatives.packed(2, 45, 1, 13)]
    assert list(negatives.opened(iter(sorted(keys)), 10, 30, 90)) == [(1, 7, 1, 9, 100, 90), (1, 7, 2, 11, 100, 45), (1, 10, 1, 11, 50, 45), (1, 10, 2, 12, 50, 29)]


def test_large_components_stay_exact():
    import numpy as np

    a = np.array([[3_000_000_000, 1], [-3, 2]])
    assert negatives.products(a, a).tolist() == [[9_000_000_000_000_000_001, -8_999_999_998], [-8_999_999_998, 13]]
