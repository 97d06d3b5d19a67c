"""Shards of near equal size by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.llm.common import dealt_rank, row_key, staged


class _Tree:
    """A treap of (room, bin) pairs: add, and take out the pair with the least room of at least n."""

    def __init__(self):
        self.root, self.dice = None, random.Random(1)

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, t, key):
        """Those below key, and the others."""
        if t is None:
            return None, None
        if t[0] < key:
            t[3], high = self._split(t[3], key)
            return t, high
        low, t[2] = self._split(t[2], key)
        return low, t

    def add(self, room: int, bin_: int) -> None:
        low, high = self._split(self.root, (room, bin_))
        self.root = self._merge(self._merge(low, [(room, bin_), self.dice.random(), None, None]), high)

    def take(self, least: int):
        low, high = self._split(self.root, (least, -1))
        if high is None:
            self.root = low
            return None
        parent, at = None, high
        while at[2] is not None:
            parent, at = at, at[2]
        if parent is None:
            high = at[3]
        else:
            parent[2] = at[3]
        self.root = self._merge(low, high)
        return at[0]

    def roomiest(self):
        at = self.root
        while at[3] is not None:
            at = at[3]
        return at[0]


def best_fit_runs(runs: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[tuple[int, int, int, int]]:
    """(size, first, end, bin): items first to end - 1 of a size go into bin, for runs (size, items) of equal items.

    Best-fit-decreasing: largest first, each item into the bin with the least room that still holds it, else a new bin. With
    most_bins bins open, an item that fits nowhere goes to the roomiest one; so does an item above the capacity. A bin that
    takes an item stays the tightest while it holds another, so a run enters it at once: the work depends on the number of
    different sizes and of bins, not on that of items.
    """
    out, tree, bins = [], _Tree(), 0
    for size, items in sorted(runs, reverse=True):
        at = 0
        while at < items:
            found = tree.take(size)
            if found is None and (most_bins is None or bins < most_bins):
                found, bins = (capacity, bins), bins + 1
            if found is None:
                found = tree.take(tree.roomiest()[0])
            n = max(1, min(items - at, found[0] // size))
            out.append((size, at, at + n, found[1]))
            tree.add(found[0] - n * size, found[1])
            at += n
    return out


def planned(runs: list[tuple[int, int]], shards: int, capacity: int | None = None) -> list[tuple[int, int, int, int]]:
    """Runs of groups dealt to `shards` bins of a capacity, by default an equal share of all sizes.

    By default, a group larger than an equal share of what is left has a shard of its own, and the others share the rest.
    """
    if capacity is not None:
        return best_fit_runs(runs, capacity, shards)
    left, rest, out = dict(runs), sum(n * c for n, c in runs), []
    for size in sorted(left, reverse=True)[:shards]:
        while left[size] and len(out) < shards - 1 and size * (shards - len(out)) > rest:
            out.append((size, len([r for r in out if r[0] == size]), len([r for r in out if r[0] == size]) + 1, len(out)))
            left[size], rest = left[size] - 1, rest - size
    own = {size: max([0, *(r[2] for r in out if r[0] == size)]) for size in left}
    free = shards - len(out)
    more = best_fit_runs([(n, c) for n, c in left.items() if c], -(-rest // free), free)
    return out + [(n, a + own[n], b + own[n], bin_ + len(out)) for n, a, b, bin_ in more]


def sharded(docs: DataFrame, shards: int = 8, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Equal texts are one indivisible group; null texts are one too (size 1, crc32 null). Groups are counted by their bytes,
    and best-fit-decreasing over these counts fills `shards` shards of a capacity (by default an equal share of all bytes; a
    group above it has a shard of its own). Every group enters by its rank among those of its size. Only the counts by size
    reach the driver: the sizes of groups that differ add up to all bytes at most, so there are under sqrt(2 * bytes) of
    them. Slots are gapless from 0 in each shard. Repeated rows and null doc_ids are rows like any others; an empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(text), size.alias("size"), F.crc32(text).alias("text_crc32"))
    own = staged(own, "sizes")
    groups = staged(own.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")), "groups")
    counts = groups.groupBy("bytes").agg(F.count("*").alias("n")).toPandas()
    plan = planned(list(zip(counts["bytes"].tolist(), counts["n"].tolist(), strict=True)), shards, capacity)
    columns = list(zip(*plan, strict=True)) or [[]] * 4
    types = {"bytes": pa.int64(), "first": pa.int64(), "end": pa.int64(), "shard": pa.int32()}
    runs = spark.createDataFrame(pa.table({c: pa.array(v, t) for (c, t), v in zip(types.items(), columns, strict=True)}))
    ranked = dealt_rank(groups, ["bytes"], F.xxhash64("k2", "k1"), "rank")
    dealt = ranked.join(runs, "bytes").filter((F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("end"))).select("k1", "k2", "shard")
    placed = own.join(staged(dealt, "dealt"), ["k1", "k2"])
    ranked = dealt_rank(placed.select("doc_id", "k1", "size", "text_crc32", "shard"), ["shard"], F.xxhash64("doc_id", "k1"), "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
