"""Removal of word windows that occur more than once, by level-wise doubling from sampled seeds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utxolens.llm.common import bucketed, staged, words_of

_BASE = 0x9E3779B97F4A7C15  # any odd number
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(k)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """64-bit hashes of any word window of a text, from one pass over its words."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_UNBASE, n + 1)
        self.n = n

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of words start to end, and of their number."""
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _anchors(roll: Rolling, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each seed that is the least, by hash, in some window: its hash and place, the first of these windows and their number."""
    at = np.arange(roll.n - seed + 1)
    hashes = roll.of(at, at + seed)
    chosen = sliding_window_view(hashes, width - seed + 1).argmin(1) + np.arange(roll.n - width + 1)
    place, first, windows = np.unique(chosen, return_index=True, return_counts=True)
    return hashes[place], place, first, windows


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _packed(first: np.ndarray, place: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A candidate in one LONG: its first window, from there to the seed, and its number of windows."""
    return (first << 16) | ((place - first) << 8) | windows


def _seeds(width: int, seed: int):
    """Rows (h, d, t, v): hash of a seed, the row's document and text, and the candidate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for d, t, text in zip(pdf["d"], pdf["t"], pdf["text"], strict=True):
                words = words_of(text)
                if len(words) < width:
                    continue
                h, place, first, windows = _anchors(Rolling(words), width, seed)
                parts.append((_signed(h), np.full(len(h), d), np.full(len(h), t), _packed(first, place, windows)))
            if parts:
                yield pd.DataFrame({k: np.concatenate(p) for k, p in zip("hdtv", zip(*parts, strict=True), strict=True)})

    return run


def levels(width: int, seed: int) -> list[int]:
    """Lengths between seed and window, each twice the one before, that fit on one side of a seed in every window."""
    out = [2 * seed]
    while 2 * out[-1] <= (width + seed + 1) // 2:
        out.append(2 * out[-1])
    return out


def _extended(width: int, seed: int, length: int):
    """Rows (key, n, d, t, v): hash of the `length` words from each candidate's seed on, or up to it.

    Windows that end too close behind the seed are a candidate of their own, extended to the left.
    """
    reach = width - levels(width, seed)[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for pdf in batches:
            parts = []
            for d, t, n, packed, found in zip(pdf["d"], pdf["t"], pdf["n"], pdf["zipped"], pdf["found"], strict=True):
                v = np.asarray(found, np.int64)
                first, windows = v >> 16, v & 255
                x = first + (v >> 8 & 255)
                right = np.maximum(first, x - reach)
                more = np.maximum(first + windows - right, 0)
                a, b = more > 0, windows > more
                own = np.concatenate([_packed(right[a], x[a], more[a]), _packed(first[b], x[b], (windows - more)[b])])
                low = np.concatenate([x[a], x[b] + seed - length])
                side = np.repeat(np.array([0, 1], np.uint64), [a.sum(), b.sum()])
                key = _mixed(Rolling(unzip.decompress(packed).split()).of(low, low + length) + side)
                parts.append((_signed(key), np.full(len(own), n), np.full(len(own), d), np.full(len(own), t), own))
            if parts:
                yield pd.DataFrame({k: np.concatenate(p) for k, p in zip(("key", "n", "d", "t", "v"), zip(*parts, strict=True), strict=True)})

    return run


def _windows(width: int, seed: int):
    """Rows (h, b, n, d, t, v, windows) of each candidate: hashes of its seed, of all its words, and of its windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for pdf in batches:
            parts = []
            for d, t, n, packed, found in zip(pdf["d"], pdf["t"], pdf["n"], pdf["zipped"], pdf["found"], strict=True):
                v, roll = np.asarray(found, np.int64), Rolling(unzip.decompress(packed).split())
                first, count = v >> 16, v & 255
                x = first + (v >> 8 & 255)
                ends = np.cumsum(count)
                starts = np.repeat(first - (ends - count), count) + np.arange(count.sum())
                block = _mixed(roll.of(first, first + count - 1 + width) + (x - first).astype(np.uint64))
                own = np.split(_signed(roll.of(starts, starts + width)), ends[:-1])
                parts.append(pd.DataFrame({"h": _signed(roll.of(x, x + seed)), "b": _signed(block), "n": n, "d": d, "t": t, "v": v, "windows": own}))
            if parts:
                yield pd.concat(parts)

    return run


def _digest(width: int, texts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for d, t, packed, spans in zip(pdf["d"], pdf["t"], pdf["zipped"], pdf["spans"], strict=True):
                words = unzip.decompress(packed).split()
                kept = words
                if spans is not None and len(spans):
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        edge[s["p"]] += 1
                        edge[s["p"] + s["k"] - 1 + width] -= 1
                    kept = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                text = b" ".join(kept)
                rows.append((d, t, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if texts else None))
            yield pd.DataFrame(rows, columns=["d", "t", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


@F.pandas_udf(T.BinaryType())
def _zipped(texts: pd.Series) -> pd.Series:
    press = zstandard.ZstdCompressor(level=3)
    return pd.Series([press.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=object)


def _repeated(rows: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """The keys that stand in rows more than once. They are written, for only a join of two plain shuffles can be split where
    a key is very common."""
    return staged(rows.groupBy(*keys).agg(F.sum(weight).alias("_n")).filter("_n > 1").select(*keys), "repeated")


def repeated_spans(keyed: DataFrame, texts: DataFrame, width: int = 35, seed: int = 5) -> DataFrame:
    """(d, t, spans): for each document with repeated windows, runs of them (first window p, number k). See removed().

    keyed has a row (d, t, text) for every row, texts one (d, t, n, zipped) for each n equal rows.
    """
    if not 0 < seed <= width // 2 or width > 255:
        raise ValueError("a seed has at most half the width, and a width at most 255 words")

    def found_in(candidates: DataFrame) -> DataFrame:
        return texts.join(candidates.groupBy("d", "t").agg(F.collect_set("v").alias("found")), ["d", "t"])

    seeds = staged(keyed.select("d", "t", "text").mapInPandas(_seeds(width, seed), "h long, d long, t long, v long"), "seeds")
    alive = seeds.join(_repeated(seeds, ["h"], F.lit(1)), "h")
    for length in levels(width, seed):
        rows = staged(found_in(alive).mapInPandas(_extended(width, seed, length), "key long, n long, d long, t long, v long"), f"level{length}")
        alive = rows.join(_repeated(rows, ["key"], F.col("n")), "key")
    rows = staged(found_in(alive).mapInPandas(_windows(width, seed), "h long, b long, n long, d long, t long, v long, windows array<long>"), "windows")

    # Equal candidates repeat each other's windows; one of them stands for all where single windows are compared.
    blocks = rows.groupBy("h", "b").agg(F.sum("n").alias("n"), F.first(F.struct("d", "t", "v", "windows")).alias("at"))
    blocks = staged(blocks.select("h", "b", "n", "at.*"), "blocks")
    first = F.shiftright("v", 16)
    settled = rows.select("h", "b", "d", "t", "v").join(blocks.filter("n > 1").select("h", "b"), ["h", "b"])
    settled = settled.select("d", "t", F.struct(first.alias("p"), F.col("v").bitwiseAND(255).alias("k")).alias("s"))
    window = blocks.select("h", "n", "d", "t", "v", F.posexplode("windows").alias("i", "w"))
    alone = window.filter("n = 1").join(_repeated(window, ["h", "w"], F.col("n")), ["h", "w"])
    alone = alone.select("d", "t", F.struct((first + F.col("i")).alias("p"), F.lit(1).cast("long").alias("k")).alias("s"))
    return settled.unionByName(alone).groupBy("d", "t").agg(F.collect_set("s").alias("spans"))


def removed(docs: DataFrame, width: int = 35, seed: int = 5, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (null unless texts) for every row of docs.

    Each word under a window of `width` words whose words also start anywhere else (in any row, the same one included) goes.
    Seeds are sampled so that equal windows have the same one: the seed of least hash in the window. Seeds that occur twice
    alone are extended to twice the length, and what occurs twice there to twice that, as long as windows allow; then to the
    full windows. What occurs once at a level goes no further, and no longer words of it are hashed. Whole texts count; null
    texts have no words. Repeated rows repeat each other's windows. Rows of the same doc_id are told apart by their texts. An
    empty table gives an empty result; other columns are not read.
    """
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    keyed = docs.select(doc.alias("doc_id"), text.alias("text"), F.coalesce(doc, F.xxhash64(F.lit("d"), text)).alias("d"), F.xxhash64(text).alias("t"))
    pressed = keyed.select("d", "t", _zipped("text").alias("zipped")).groupBy("d", "t").agg(F.count("*").alias("n"), F.first("zipped").alias("zipped"))
    pressed = bucketed(pressed, ["d", "t"], "texts")
    spans = staged(repeated_spans(keyed, pressed, width, seed), "spans")
    joined = pressed.join(spans, ["d", "t"], "left").select("d", "t", "zipped", "spans")
    done = staged(joined.mapInPandas(_digest(width, texts), "d long, t long, n_words long, n_removed long, kept_sha256 string, kept string"), "digests")
    return keyed.select("doc_id", "d", "t").join(done, ["d", "t"]).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")
