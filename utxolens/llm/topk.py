"""Exact top-k inner products over a bit-sliced index of quantised vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utxolens.llm.common import ordinal, staged

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _bitmap(rows: np.ndarray) -> np.ndarray:
    """Booleans, along the last axis, as 64-bit words."""
    packed = np.packbits(rows, axis=-1, bitorder="little")
    packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], -packed.shape[-1] % 8), np.uint8)], axis=-1)
    return np.ascontiguousarray(packed).view(np.uint64)


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _slices(block_rows: int):
    """Blocks of at most block_rows rows of one dimension, ordered by id: ids, least component, bits, slices."""

    def block(ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        low = int(values.min()) if values.size else 0
        bits = int(values.max() - low).bit_length() if values.size else 0
        above = (values - low).T
        slices = np.stack([_bitmap((above >> j & 1).astype(bool)) for j in range(bits)], axis=1) if bits else np.zeros((values.shape[1], 0, -(-len(ids) // 64)), np.uint64)
        return values.shape[1], len(ids), ids.tobytes(), low, bits, slices.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, held = TaskContext.get().partitionId(), 0, {}

        def made(parts):
            nonlocal number
            rows = [(task, number, *block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))]
            number += 1
            return pd.DataFrame(rows, columns=["task", "number", "dim", "n", "ids", "low", "bits", "slices"])

        for pdf in batches:
            for dim, own in pdf.groupby(pdf["v"].map(len)):
                ids, values = own["vec_id"].to_numpy(np.int64), np.stack(own["v"].to_list()).astype(np.int64).reshape(len(own), dim)
                for i in range(0, len(ids), block_rows):
                    parts = held.setdefault(dim, [])
                    if sum(len(p[0]) for p in parts) + len(ids[i : i + block_rows]) > block_rows:
                        yield made(held.pop(dim))
                        parts = held.setdefault(dim, [])
                    parts.append((ids[i : i + block_rows], values[i : i + block_rows]))
        for parts in held.values():
            if parts:
                yield made(parts)

    return run


def _grouped(per_block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby(pdf["v"].map(len)):
                for i in range(0, len(own), per_block):
                    part = own.iloc[i : i + per_block]
                    yield pd.DataFrame([(dim, part["vec_id"].to_numpy(np.int64).tobytes(), np.stack(part["v"].to_list()).astype(np.int64).tobytes())], columns=["dim", "ids", "vectors"])

    return run


def sums(slices: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Bit slices (T, queries, words) of the sums over dimensions of |q| * u, or |q| * ~u where q is negative.

    slices: (dimensions, bits, words). Each bit of |q| adds the attribute's slices, shifted; three bitmaps of one weight are
    turned into one of it and a carry of the next, until a last pass carries through.
    """
    size, sign = np.abs(queries), np.where(queries < 0, _ONES, np.uint64(0))
    dims, bits, words = slices.shape
    pending: list[list[np.ndarray]] = [[] for _ in range(bits + int(size.max(initial=0)).bit_length() + int(dims).bit_length() + 2)]

    def add(bitmap: np.ndarray, weight: int) -> None:
        own = pending[weight]
        own.append(bitmap)
        while len(own) == 3:
            a, b, c = own
            half = a ^ b
            pending[weight] = own = [half ^ c]
            carry, weight = (a & b) | (half & c), weight + 1
            own = pending[weight]
            own.append(carry)

    for d in range(dims):
        turned = [slices[d, j][None, :] ^ sign[:, d][:, None] for j in range(bits)]
        for t in range(int(size[:, d].max(initial=0)).bit_length()):
            mask = np.where(size[:, d] >> t & 1, _ONES, np.uint64(0))[:, None]
            for j in range(bits):
                add(turned[j] & mask, t + j)
    out, carry = [], None
    for own in pending:
        own = own + ([carry] if carry is not None else [])
        carry = None
        if len(own) == 3:
            a, b, c = own
            out.append(a ^ b ^ c)
            carry = (a & b) | (c & (a ^ b))
        elif len(own) == 2:
            out.append(own[0] ^ own[1])
            carry = own[0] & own[1]
        else:
            out.append(own[0] if own else np.zeros((len(queries), words), np.uint64))
    return np.stack(out)


def top_rows(planes: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows that are surely among the k highest of each query, and of the rows that tie for the last places."""
    sure, tied = np.zeros_like(candidates), candidates.copy()
    open_ = np.ones(len(candidates), bool)
    for plane in planes[::-1]:
        with_bit = tied & plane
        more = sure | with_bit
        n = np.bitwise_count(more).sum(axis=1)
        high, low = open_ & (n >= k), open_ & (n < k)
        tied = np.where(high[:, None], with_bit, np.where(low[:, None], tied & ~plane, tied))
        sure = np.where(low[:, None], more, sure)
        open_ &= n != k
    return sure, tied


def _search(k: int, at_once: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                words = -(-r.n // 64)
                slices = np.frombuffer(r.slices, np.uint64).reshape(r.dim, r.bits, words)
                own_ids = np.frombuffer(r.query_ids, np.int64)
                vectors = np.frombuffer(r.vectors, np.int64).reshape(len(own_ids), r.dim)
                valid = _bitmap(np.ones(r.n, bool))
                found = []
                for i in range(0, len(own_ids), at_once):
                    q, name = vectors[i : i + at_once], own_ids[i : i + at_once]
                    planes = sums(slices, q)
                    candidates = np.repeat(valid[None, :], len(q), axis=0)
                    for j, (lo, hi) in enumerate(zip(np.searchsorted(ids, name), np.searchsorted(ids, name, side="right"), strict=True)):
                        for row in range(lo, hi):  # rows of the query's own id
                            candidates[j, row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
                    sure, tied = top_rows(planes, candidates, k)
                    most = (1 << r.bits) - 1
                    shift = r.low * q.sum(axis=1) - most * np.where(q < 0, -q, 0).sum(axis=1)
                    for j in range(len(q)):
                        rows = _rows_of(sure[j])
                        rows = np.concatenate([rows, _rows_of(tied[j])[: k - len(rows)]])  # rows stand in the order of ids
                        bit = planes[:, j, rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)
                        score = (bit.astype(np.int64) << np.arange(len(planes))[:, None]).sum(axis=0) + shift[j]
                        found.append((np.full(len(rows), name[j]), np.full(len(rows), xxhash.xxh3_64_intdigest(q[j].tobytes()) >> 1), ids[rows], score))
                yield pd.DataFrame({c: np.concatenate([f[x] for f in found]) for x, c in enumerate(("query_id", "query", "vec_id", "score"))})

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, block_rows: int = 8192, per_block: int = 256, at_once: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row of vectors where `queries` holds.

    Components become floor(scale * x). Every other row is a candidate; ties go to the smaller vec_id. Rows with a null id, a
    null vector, or a null or non-finite component take no part; only vectors of the same length meet. Rows of the query's
    own vec_id are the query itself; other repeated rows are candidates of their own, and repeated query rows with equal
    vectors are one query. Fewer than k candidates: all of them. An empty table gives an empty result. Sums must fit a LONG.

    The index holds blocks of rows as bit slices; blocks of queries go to every block of the index (the shuffle moves queries,
    never the index more than once). Slices are added with bitmap arithmetic, the top is chosen from the highest slice
    down, and rows that tie at the boundary are taken by id. k rows for each query and block go on to a ranking.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"), queries.alias("q"))
    own = own.filter(F.col("vec_id").isNotNull() & usable(F.col("e"))).select("vec_id", quantised(F.col("e"), scale).alias("v"), "q")
    index = own.select("vec_id", "v").mapInPandas(_slices(block_rows), "task int, number int, dim int, n int, ids binary, low long, bits int, slices binary")
    index = staged(ordinal(staged(index, "slices"), [F.col("task"), F.col("number")], "block"), "index")
    blocks = index.count()
    asked = own.filter("q").select("vec_id", "v").distinct()
    asked = asked.mapInPandas(_grouped(per_block), "dim int, ids binary, vectors binary").withColumnRenamed("ids", "query_ids")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1)).cast("array<bigint>")))
    cells = index.join(asked, ["block", "dim"])
    schema = "query_id long, query long, vec_id long, score long"
    found = cells.select("dim", "n", "ids", "low", "bits", "slices", "query_ids", "vectors").mapInPandas(_search(k, at_once), schema)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
