"""Hard negatives by a secondary sort: scores of each anchor arrive in descending order, and positives open windows for negatives."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utxolens.llm.common import ordinal, staged
from utxolens.llm.topk import quantised, usable

_SIGN = 1 << 63
_KEY = ">QQBQ"
_EXACT = float(1 << 53)


def packed(anchor: int, score: int, kind: int, vec_id: int) -> bytes:
    """A key whose order as bytes is (anchor, descending score, kind, vec_id)."""
    return struct.pack(_KEY, anchor + _SIGN, _SIGN - 1 - score, kind, vec_id + _SIGN)


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, vec_id = struct.unpack(_KEY, key)
    return anchor - _SIGN, _SIGN - 1 - score, kind, vec_id - _SIGN


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b: in double precision where sums stay below 2 ** 53."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _blocks(block_rows: int, columns: list[str], lists: tuple[str, ...] = ()):
    """Blocks of at most block_rows rows with vectors of one length: the length, bytes of each column, one item a row of each list, bytes of the vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}

        def made(dim):
            own = pd.concat(held.pop(dim))
            row = [dim, *(own[c].to_numpy(np.int64).tobytes() for c in columns), *([np.asarray(x, np.int64).tobytes() for x in own[c]] for c in lists), np.stack(own["v"].to_list()).astype(np.int64).tobytes()]
            return pd.DataFrame([row], columns=["dim", *columns, *lists, "vectors"])

        for pdf in batches:
            for dim, own in pdf.groupby(pdf["v"].map(len)):
                for i in range(0, len(own), block_rows):
                    part = own.iloc[i : i + block_rows]
                    if sum(map(len, held.get(dim, []))) + len(part) > block_rows:
                        yield made(dim)
                    held.setdefault(dim, []).append(part)
        for dim in list(held):
            yield made(dim)

    return run


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def _positives(k: int):
    """The k best rows of the anchor's label in each block."""

    def run(batches):
        for pdf in batches:
            found = []
            for r in pdf.itertuples():
                ids, labels, asked, own = _numbers(r.ids), _numbers(r.labels), _numbers(r.anchors), _numbers(r.anchor_ids)
                wanted = _numbers(r.anchor_labels)
                rows = np.flatnonzero(np.isin(labels, wanted))
                scores = products(_numbers(r.asked).reshape(len(asked), r.dim), _numbers(r.vectors).reshape(len(ids), r.dim)[rows])
                for i in range(len(asked)):
                    at = np.flatnonzero((labels[rows] == wanted[i]) & (ids[rows] != own[i]))
                    best = at[_first(scores[i, at], ids[rows][at], k)]
                    found.append(pd.DataFrame({"anchor": asked[i], "anchor_id": own[i], "vec_id": ids[rows][best], "score": scores[i, best]}))
            if found:
                yield pd.concat(found)

    return run


def _negatives(k: int, low: int, high: int):
    """The k best rows in each window of an anchor in each block; a row in many windows comes once."""

    def run(batches):
        for pdf in batches:
            found = []
            for r in pdf.itertuples():
                ids, labels, asked, own = _numbers(r.ids), _numbers(r.labels), _numbers(r.anchors), _numbers(r.anchor_ids)
                wanted, bounds = _numbers(r.anchor_labels), [_numbers(x) for x in r.positives]
                scores = products(_numbers(r.asked).reshape(len(asked), r.dim), _numbers(r.vectors).reshape(len(ids), r.dim))
                for i in range(len(asked)):
                    at = np.flatnonzero((labels != wanted[i]) & (ids != own[i]))
                    score, best = scores[i, at], [np.zeros(0, np.int64)]
                    for p in set(bounds[i].tolist()):
                        inside = np.flatnonzero((100 * score >= low * p) & (100 * score <= high * p))
                        best.append(inside[_first(score[inside], ids[at][inside], k)])
                    best = np.unique(np.concatenate(best))
                    found.append(pd.DataFrame({"anchor": asked[i], "anchor_id": own[i], "vec_id": ids[at][best], "score": score[best]}))
            if found:
                yield pd.concat(found)

    return run


def opened(keys: Iterator[bytes], k: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) from sorted keys, one pass.

    A positive opens a window; each negative goes to the open windows that it falls into, until a window has k of them or
    scores have left it. Only the open windows of one anchor are held.
    """
    now, windows = None, []
    for anchor, score, kind, vec_id in map(unpacked, keys):
        if anchor != now:
            now, windows = anchor, []
        if kind == 0:
            windows.append([vec_id, score, 0])
            continue
        windows = [w for w in windows if w[2] < k and 100 * score >= low * w[1]]
        for w in windows:
            if 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], vec_id, w[1], score


def mined(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, block_rows: int = 8192, per_block: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each row of vectors (vec_id, embedding, label) where `anchors` holds.

    Scores are integer inner products of floor(scale * x), higher first, ties by smaller vec_id. An anchor's positives are its
    first `positives` other rows of its label; each gets the first `negatives` rows of other labels with
    low * positive <= 100 * negative <= high * positive (fewer where there are fewer). Rows with a null id or label, or a null
    vector, or a null or non-finite component take no part; only vectors of the same length meet. Rows of the anchor's vec_id are the anchor itself. Equal
    rows are one row; rows of one vec_id that differ are rows and anchors of their own. Sums must fit a LONG. An empty table, no
    anchors or no positives give no rows; other columns are not read.

    Blocks of anchors go to every block of rows. A block first gives its best rows of the anchor's label, of which the best of
    all blocks are the positives; then, these known, its best rows in each window. No block's choice can leave out a row that the
    whole table would choose, so what is shuffled is a few rows for each anchor and block, not all pairs. The keys
    (anchor, descending score, id) are sorted by the shuffle itself; an anchor with any number of rows streams through one pass.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("e"), F.coalesce(anchors, F.lit(False)).alias("q"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("e"))).select("vec_id", "label", quantised(F.col("e"), scale).alias("v"), "q").distinct()
    own = staged(own, "vectors")
    asked = staged(ordinal(own.filter("q").drop("q"), [F.col("vec_id"), F.col("label"), F.xxhash64("v")], "anchor"), "anchors")
    rows = own.select(F.col("vec_id").alias("ids"), F.col("label").alias("labels"), "v").mapInPandas(_blocks(block_rows, ["ids", "labels"]), "dim int, ids binary, labels binary, vectors binary")
    rows = staged(ordinal(staged(rows, "rows"), [F.col("dim"), F.xxhash64("ids"), F.xxhash64("vectors")], "block"), "blocks")
    blocks = max(rows.count(), 1)

    def met(asked: DataFrame, lists: tuple[str, ...] = ()) -> DataFrame:
        """Blocks of anchors beside every block of rows of the same length."""
        columns = ["anchors", "anchor_ids", "anchor_labels"]
        own = asked.select(F.col("anchor").alias("anchors"), F.col("vec_id").alias("anchor_ids"), F.col("label").alias("anchor_labels"), "v", *lists)
        schema = ["dim int", *(f"{c} binary" for c in columns), *(f"{c} array<binary>" for c in lists), "vectors binary"]
        own = own.mapInPandas(_blocks(per_block, columns, lists), ", ".join(schema)).withColumnRenamed("vectors", "asked")
        return rows.join(own.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))), ["block", "dim"])

    schema = "anchor long, anchor_id long, vec_id long, score long"
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    near = met(asked).mapInPandas(_positives(positives), schema).withColumn("place", F.row_number().over(best))
    near = staged(near.filter(F.col("place") <= positives).drop("place"), "positives")
    bounds = near.groupBy("anchor").agg(F.collect_list("score").alias("positives"))  # at most `positives` of them
    far = met(asked.join(bounds, "anchor"), ("positives",)).mapInPandas(_negatives(negatives, low, high), schema)
    scored = near.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1))).select("anchor", "score", "kind", "vec_id")

    spark = vectors.sparkSession
    keys = staged(scored, "scores").rdd.map(lambda r: (packed(*r), None))
    ordered = keys.repartitionAndSortWithinPartitions(int(spark.conf.get("spark.sql.shuffle.partitions")), lambda key: int.from_bytes(key[:8], "big"))
    found = ordered.mapPartitions(lambda part: opened((key for key, _ in part), negatives, low, high))
    found = spark.createDataFrame(found, "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found.join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
