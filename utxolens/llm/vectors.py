"""Near-duplicate embeddings: inverted lists with product-quantised residuals, exact cosine at the end."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utxolens.llm.common import components, ordinal, staged
from utxolens.llm.topk import usable


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def _blocks(rows: int, per_row: int, most: int = 4_000_000) -> Iterator[slice]:
    """Slices of rows that make matrices of at most `most` numbers."""
    step = max(1, most // max(per_row, 1))
    return (slice(at, at + step) for at in range(0, rows, step))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_near(x[b], centres).argmin(1) for b in _blocks(len(x), len(centres)))])


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, d], len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Index:
    """Coarse and fine centres, each sum of two stands for a list; for each subspace its columns and codebook for residuals."""

    coarse: np.ndarray
    fine: np.ndarray
    columns: list[np.ndarray]
    books: list[np.ndarray]

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def lists(self, x: np.ndarray, probes: int, first: int = 8) -> np.ndarray:
        """The `probes` nearest lists of each vector, nearest first, among those of its `first` nearest coarse centres."""
        first, cross = min(first, len(self.coarse)), self.coarse @ self.fine.T
        probes, out = min(probes, first * len(self.fine)), []
        for b in _blocks(len(x), len(self.coarse) + first * len(self.fine)):
            d = _near(x[b], self.coarse)
            near = np.argpartition(d, first - 1, axis=1)[:, :first]
            own = np.take_along_axis(d, near, 1)[:, :, None] - 2 * (x[b] @ self.fine.T)[:, None, :] + 2 * cross[near] + (self.fine * self.fine).sum(1)
            own, names = own.reshape(len(own), -1), (near[:, :, None] * len(self.fine) + np.arange(len(self.fine))).reshape(len(own), -1)
            best = np.argpartition(own, probes - 1, axis=1)[:, :probes]
            best = np.take_along_axis(best, np.take_along_axis(own, best, 1).argsort(1, kind="stable"), 1)
            out.append(np.take_along_axis(names, best, 1))
        return np.concatenate(out)

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each residual from what its code stands for."""
        codes = np.stack([_nearest(residuals[:, c], b) for c, b in zip(self.columns, self.books, strict=True)], axis=1)
        off = sum(((residuals[:, c] - b[codes[:, i]]) ** 2).sum(1) for i, (c, b) in enumerate(zip(self.columns, self.books, strict=True)))
        return codes.astype(np.uint8), np.sqrt(off)

    def distances(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances from exact residuals to coded ones, by a table per subspace (asymmetric)."""
        out = np.zeros((len(residuals), len(codes)))
        for i, (c, b) in enumerate(zip(self.columns, self.books, strict=True)):
            out += _near(residuals[:, c], b)[:, codes[:, i]]
        return out


def train(sample: np.ndarray, rows: int, subspaces: int = 8, book: int = 64, per_list: int = 256) -> Index:
    """Fit an index for `rows` unit vectors on a sample of them: about rows / per_list lists, from two levels of centres.

    Each level has as many centres as the root of that number, and a sixteenth of the sample at most.
    """
    side = max(1, min(math.ceil(math.sqrt(rows / per_list)), len(sample) // 16))
    coarse = k_means(sample, side)
    rest = sample - coarse[_nearest(sample, coarse)]
    fine = k_means(rest, side)
    rest = rest - fine[_nearest(rest, fine)]
    columns = [c for c in np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1])) if len(c)]
    return Index(coarse, fine, columns, [k_means(rest[:, c], book) for c in columns])


def _unit(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out / np.sqrt((out * out).sum(1))[:, None]


def _entries(index: Index, width: int, probes: int):
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _unit(pdf["v"], width)
            lists = index.lists(x, probes)
            out = []
            for p in range(lists.shape[1]):
                codes, off = index.encode(x - index.centre(lists[:, p]))
                out.append(pdf.assign(list=lists[:, p].astype("int32"), lists=list(lists.astype("int32")), code=[c.tobytes() for c in codes], off=off))
            yield pd.concat(out)[["cid", "label", "n", "v", "list", "lists", "code", "off"]]

    return run


def _pairs(index: Index, width: int, cosine: float, chunk: int = 256):
    """Links inside one tile: for each linked vector the vectors linked there, and the least one its links reach there."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["list"].iloc[0])
        pdf = pdf.sort_values("cid")
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x, ids, weight, block = _unit(pdf["v"], width), pdf["cid"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), pdf["b"].to_numpy()
        dims, lists, off = pdf["v"].map(len).to_numpy(), np.stack(pdf["lists"].to_list()), pdf["off"].to_numpy()
        codes = np.stack([np.frombuffer(c, np.uint8) for c in pdf["code"]])
        a_all, b_all = np.flatnonzero(block == i), np.flatnonzero(block == j)
        residuals = x - index.centre(np.array([cell]))
        added, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for at in range(0, len(a_all), chunk):
            a = a_all[at : at + chunk]
            maybe = index.distances(residuals[a], codes[b_all]) <= (reach + off[b_all] + 1e-6)[None, :] ** 2
            r, c = np.nonzero(maybe)
            r, c = a[r], b_all[c]
            ok = (r < c) if i == j else np.ones(len(r), bool)
            r, c = r[ok], c[ok]
            for s in range(0, len(r), 50_000):
                p, q = r[s : s + 50_000], c[s : s + 50_000]
                ok = ((x[p] * x[q]).sum(1) >= cosine) & (dims[p] == dims[q])
                p, q = p[ok], q[ok]
                both = (lists[p][:, :, None] == lists[q][:, None, :]).any(2)
                ok = np.where(both, lists[p], np.iinfo(np.int32).max).min(1) == cell  # of the lists they share, the least counts
                p, q = p[ok], q[ok]
                np.add.at(added, p, weight[q])
                np.add.at(added, q, weight[p])
                for k, m in zip(p.tolist(), q.tolist(), strict=True):
                    k, m = top(k), top(m)
                    if k != m:
                        root[max(k, m)] = min(k, m)
        linked = np.flatnonzero(added)
        return pd.DataFrame({"cid": ids[linked], "added": added[linked], "root": ids[[top(k) for k in linked]] if len(linked) else ids[:0]})

    return run


def near_vectors(table: DataFrame, cosine: float = 0.98, sample: int = 16_384, probes: int = 6, tile: int = 1024, per_list: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of table (vec_id, embedding, label).

    Vectors of equal labels link at a cosine of at least `cosine`, in double precision. Rows with a null id or label, or a
    null, zero or non-finite vector, link with nothing and reach themselves; so do vectors of different lengths. Equal
    vectors of a label are one class, so copies never meet as pairs; each of them counts as a vector. An empty table gives an
    empty result.

    The index is fitted on at most `sample` classes, the first by hash, with about one list for `per_list` classes (at most a
    million lists for the default sample, after which lists grow); every class is entered in its `probes` nearest lists, with
    the code of its residual there. Classes meet in the lists they share, in tiles of two blocks of about `tile`
    entries. Table-lookup distances, widened by the known error of the code, can only drop pairs that are too far; exact
    cosines decide the others. Each tile gives sums and spanning links, never its pairs.
    """
    vector = F.col("v")
    number = "float" if isinstance(table.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.transform("embedding", lambda x: x.cast(number)).alias("v"))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", F.coalesce(valid, F.lit(False)))
    rows = rows.withColumn("k1", F.xxhash64("label", "v")).withColumn("k2", F.xxhash64(F.lit("second"), "label", "v"))
    classes = rows.filter("ok").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    classes = staged(ordinal(classes, [F.col("least"), F.col("k1"), F.col("k2")], "cid"), "classes")
    total, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    own = classes.select("k1", "k2", "cid", "n", "least")
    if total:
        taken = classes.orderBy(F.xxhash64("k1"), "k1").limit(sample).select("v").toPandas()  # at most `sample` vectors
        index = train(_unit(taken["v"], width), total, per_list=per_list)
        entries = classes.select("cid", "label", "n", "v").mapInPandas(_entries(index, width, probes), f"cid long, label {dict(classes.dtypes)['label']}, n long, v array<{number}>, list int, lists array<int>, code binary, off double")
        entries = staged(entries, "entries")
        sizes = entries.groupBy("label", "list").agg(F.ceil(F.count("*") / tile).cast("int").alias("g"))
        entries = entries.join(sizes, ["label", "list"]).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("g")).cast("int"))
        entries = entries.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("i", F.least("b", "t")).withColumn("j", F.greatest("b", "t"))
        links = entries.groupBy("label", "list", "i", "j").applyInPandas(_pairs(index, width, cosine), "cid long, added long, root long")
        links = staged(links, "links")
        reached = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
        reached = reached.join(own.select(F.col("cid").alias("component"), F.col("least").alias("reached")), "component").select(F.col("node").alias("cid"), "reached")
        own = own.join(links.groupBy("cid").agg(F.sum("added").alias("added")), "cid", "left").join(reached, "cid", "left")
    else:
        own = own.withColumn("added", F.lit(0)).withColumn("reached", F.col("least"))
    own = own.select("k1", "k2", (F.col("n") - 1 + F.coalesce("added", F.lit(0))).alias("links"), F.coalesce("reached", "least").alias("reached"))
    out = rows.filter("ok").join(own, ["k1", "k2"]).select("vec_id", F.col("links").alias("n_links"), F.col("reached").alias("component_id"))
    out = out.unionByName(rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
