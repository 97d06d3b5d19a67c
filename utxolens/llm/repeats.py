"""Removal of byte strings that occur more than once, by maximal repeats from a common-prefix interval tree over a sparse suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utxolens.llm.common import dropped, row_key, staged

_BASE = 0x9E3779B97F4A7C15  # any odd number
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_PLACE = np.uint64((1 << 24) - 1)


class _Powers:
    """Powers of a number modulo 2 ** 64, as many as were ever asked for."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.known):
            steps = np.full(2 * n, self.base, np.uint64)
            steps[0] = 1
            self.known = np.cumprod(steps, dtype=np.uint64)
        return self.known[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_UNBASE)


def _mixed(h: np.ndarray) -> np.ndarray:
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(k)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """64-bit hashes of any byte string of a piece of text, from one pass over its bytes; equal strings have equal hashes in all texts."""

    def __init__(self, data: bytes):
        own = _BYTE[np.frombuffer(data, np.uint8)]
        self.n = len(own)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(own * _UP(self.n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * _DOWN(self.n + 1)[start] + (end - start).astype(np.uint64))

    def each(self, length: int) -> np.ndarray:
        """Hashes of the strings of one length, at every place."""
        n = self.n - length + 1
        return _mixed((self.sums[length:] - self.sums[:n]) * _DOWN(n) + np.uint64(length))


def sliding_minimum(x: np.ndarray, span: int) -> np.ndarray:
    """Minima of x[i : i + span], by minima from the left and from the right inside blocks of span."""
    n = len(x) - span + 1
    blocks = np.concatenate([x, np.full(-len(x) % span, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[span - 1 : span - 1 + n])


def candidates(pieces: list[bytes], length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(piece, first, number, key, b): runs of windows of `length` bytes in pieces of text, a MB or so in all.

    A window belongs to its least seed, by hash, the first of equals. Windows that hold half a length from the seed on have that half's
    hash as key, others the hash of the half up to the seed's end. So equal windows have the same key, at the same place in them. Every window
    is in one run; b is the hash of the stretch that the run's windows make up.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(sizes) - sizes
    data = b"".join(pieces)
    total, half = len(data) - length + 1, length // 2
    if total <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    edge = np.zeros(total + 1, np.int8)
    np.add.at(edge, begin[sizes >= length], 1)
    np.add.at(edge, (begin + sizes - length + 1)[sizes >= length], -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    roll = Rolling(data)
    order = (roll.each(seed) & ~_PLACE) | np.arange(len(data) - seed + 1, dtype=np.uint64)
    chosen = (sliding_minimum(order, length - seed + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1])]))
    number = np.diff(np.append(first, total))[inside[first]]
    first = first[inside[first]]
    place = chosen[first]
    late = np.maximum(first, place - (length - half))  # windows from here on have half a length from the seed on
    right = first + number - late
    a, c = right > 0, late > first
    key = np.concatenate([roll.of(place[a], place[a] + half), roll.of(place[c] + seed - half, place[c] + seed) + np.uint64(1)])
    number = np.concatenate([right[a], np.minimum(late - first, number)[c]])
    first = np.concatenate([late[a], first[c]])
    piece = np.searchsorted(begin, first, side="right") - 1
    return piece, first - begin[piece], number, key, roll.of(first, first + number - 1 + length)


@F.pandas_udf(T.BinaryType())
def _zipped(texts: pd.Series) -> pd.Series:
    press = zstandard.ZstdCompressor(level=3)
    return pd.Series([press.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=object)


def _runs(length: int, seed: int, segment: int = 1 << 20):
    """Rows (key, b, d, n, v) of each text's candidates; v has the first window and the number of windows. Long texts go by segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        held, room = [], segment

        def made() -> pd.DataFrame:
            piece, first, number, key, b = candidates([x[3] for x in held], length, seed)
            d, n, at = (np.array([x[i] for x in held], np.int64)[piece] for i in range(3))
            return pd.DataFrame({"key": key.view(np.int64), "b": b.view(np.int64), "d": d, "n": n, "v": at + first << 16 | number})

        for pdf in batches:
            for d, n, zipped in pdf[["d", "n", "zipped"]].itertuples(index=False):
                text = unzip.decompress(zipped)
                for at in range(0, len(text) - length + 1, segment):
                    piece = text[at : at + segment + length - 1]
                    held.append((d, n, at, piece))
                    room -= len(piece)
                    if room <= 0:
                        yield made()
                        held, room = [], segment
        if held:
            yield made()

    return run


def _windows(length: int, segment: int = 1 << 20):
    """Rows (r, n, d, p, stretch, w, left) of single stretches: text, hashes of the windows, and the byte before each; -1 before the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        held, room = [], segment

        def made() -> pd.DataFrame:
            out = pd.DataFrame(held, columns=["r", "n", "d", "p", "stretch"])
            data = b"".join(out["stretch"])
            w, before = Rolling(data).each(length).view(np.int64), np.frombuffer(b"\0" + data, np.uint8).astype(np.int16)
            ends = np.cumsum([len(x) for x in out["stretch"]])
            begins = ends - [len(x) for x in out["stretch"]]
            before[begins] = -1
            out["w"] = [w[a : b - length + 1] for a, b in zip(begins, ends, strict=True)]
            out["left"] = [before[a : b - length + 1] for a, b in zip(begins, ends, strict=True)]
            return out

        for pdf in batches:
            for d, zipped, found in pdf[["d", "zipped", "found"]].itertuples(index=False):
                text = unzip.decompress(zipped)
                for x in found:
                    first, number = x["v"] >> 16, x["v"] & 0xFFFF
                    held.append((x["r"], x["n"], d, first, text[first : first + number - 1 + length]))
                    room -= number + length
                    if room <= 0:
                        yield made()
                        held, room = [], segment
        if held:
            yield made()

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


class _Edge:
    """Rows of a piece of the suffix array as its neighbour sees them: (common prefix with the edge, copies, least and greatest byte before)."""

    def __init__(self, length: int):
        self.length, self.groups, self.low, self.open = length, [], 1 << 30, True

    def add(self, common: int, n: int, left: int) -> None:
        """A row further inside, with `common` bytes in common with the row before it (the first row: any large number)."""
        if self.open:
            self.low = min(self.low, common)
            self.open = self.low >= self.length
            if self.open:
                if not self.groups or self.groups[-1][0] > self.low:
                    self.groups.append([self.low, 0, left, left])
                g = self.groups[-1]
                g[1:] = g[1] + n, min(g[2], left), max(g[3], left)


def _task() -> int:
    return TaskContext.get().partitionId()


def _arrayed(length: int, piece: Callable[[], int] = _task):
    """Rows of one piece of the suffix array, in order, with the common prefix of each with the row before; then one row of edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, before, first = piece(), 0, None, None
        front, back = _Edge(length), []  # back: as an edge of what was read so far, nearest last
        for pdf in batches:
            common = []
            for suffix, n, left in zip(pdf["suffix"], pdf["n"].tolist(), pdf["left"].tolist(), strict=True):
                own = _common(before, suffix) if before is not None else 1 << 30
                common.append(own)
                front.add(own, n, left)
                if own < length:
                    back = []
                last = [1 << 30, n, left, left]
                kept: list[list[int]] = []
                for g in back:
                    g[0] = min(g[0], own)
                    if kept and kept[-1][0] == g[0]:
                        k = kept[-1]
                        k[1:] = k[1] + g[1], min(k[2], g[2]), max(k[3], g[3])
                    else:
                        kept.append(g)
                back = [*kept, last]
                first, before = suffix if first is None else first, suffix
            if common:
                out = pdf.assign(part=part, i=np.arange(at, at + len(pdf)), common=common, front=None, back=None, whole=None)
                at += len(pdf)
                yield out
        if at:
            # `back` is nearest last; all of a piece that stays open reaches its other edge with the least common prefix in it.
            edge = {"suffix": first, "part": part, "i": -1, "n": 0, "left": 0, "r": 0, "d": 0, "p": 0, "o": 0, "common": front.low if front.open else 0}
            edge |= {"front": front.groups, "back": back[::-1], "whole": before}
            yield pd.DataFrame([edge])

    return run


def capped(groups, most: int, length: int) -> list[list[int]]:
    """Edge groups as seen past a neighbour with `most` bytes in common."""
    out: list[list[int]] = []
    for common, n, low, high in groups:
        common = min(common, most)
        if common < length:
            break
        if out and out[-1][0] == common:
            g = out[-1]
            g[1:] = g[1] + n, min(g[2], low), max(g[3], high)
        else:
            out.append([common, n, low, high])
    return out


def outside(edges: list[dict], length: int) -> dict[int, tuple[list, list]]:
    """For each piece of the suffix array, what lies before and after it and has `length` bytes in common with its edge, nearest first."""
    edges = sorted(edges, key=lambda e: e["part"])
    out: dict[int, tuple[list, list]] = {}
    before: dict[int, list] = {}
    for ours, other in zip(edges[1:], edges[:-1], strict=True):
        reach = capped(before.get(other["part"], []), other["common"], length)
        before[ours["part"]] = capped([*other["back"], *reach], _common(other["whole"], ours["suffix"]), length)
    after: dict[int, list] = {}
    for ours, other in zip(edges[-2::-1], edges[:0:-1], strict=True):
        reach = capped(after.get(other["part"], []), other["common"], length)
        after[ours["part"]] = capped([*other["front"], *reach], _common(ours["whole"], other["suffix"]), length)
    for e in edges:
        found = before.get(e["part"], []), after.get(e["part"], [])
        if found[0] or found[1]:
            out[e["part"]] = found
    return out


def interval_tree(common: list[int], n: list[int], left: list[int], sizes: list[int], length: int, before=(), after=()) -> tuple[list[list[int]], list[int]]:
    """Nodes [common prefix, copies, least and greatest byte before, parent, a row of it] and each row's deepest node, -1 for none.

    One scan with a stack over the rows of a suffix array; common[i] is the common prefix of rows i - 1 and i. Rows that stand for
    many copies are a node of their own. before and after are what has a common prefix with the first and the last row, nearest first.
    """
    leaves = [(None, *g[1:]) for g in reversed(before)] + [(i, n[i], left[i], left[i]) for i in range(len(n))] + [(None, *g[1:]) for g in after]
    gaps = [0, *(g[0] for g in reversed(before)), *(common[1:] if len(n) else []), *(g[0] for g in after), 0]
    gaps = [g if g >= length else 0 for g in gaps]
    nodes, deepest, stack = [[0, 0, 256, -2, -1, -1]], [-1] * len(n), [0]

    def grow(node: int, copies: int, low: int, high: int, row: int) -> None:
        x = nodes[node]
        x[1:4] = x[1] + copies, min(x[2], low), max(x[3], high)
        if x[5] < 0:
            x[5] = row

    for k, (row, copies, low, high) in enumerate(leaves):
        follows = gaps[k + 1]
        if follows > nodes[stack[-1]][0]:
            stack.append(len(nodes))
            nodes.append([follows, 0, 256, -2, -1, -1])
        own = stack[-1]
        if row is not None and copies > 1 and nodes[own][0] < sizes[row]:
            nodes.append([sizes[row], copies, low, high, own, row])
            own = len(nodes) - 1
            grow(stack[-1], copies, low, high, row)
        else:
            grow(own, copies, low, high, -1 if row is None else row)
        if row is not None:
            deepest[row] = own if own else -1
        while nodes[stack[-1]][0] > follows:
            done = stack.pop()
            if nodes[stack[-1]][0] < follows:
                stack.append(len(nodes))
                nodes.append([follows, 0, 256, -2, -1, -1])
            nodes[done][4] = stack[-1]
            grow(stack[-1], *nodes[done][1:4], nodes[done][5])
    return nodes, deepest


def _scanned(length: int, around: dict[int, tuple[list, list]]):
    """Maximal repeats of one piece: a row for each member, under the deepest repeat that varies to the left, and one for each repeat."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        suffixes = pdf["suffix"].tolist()
        nodes, deepest = interval_tree(pdf["common"].tolist(), pdf["n"].tolist(), pdf["left"].tolist(), list(map(len, suffixes)), length, *around.get(int(pdf["part"].iloc[0]), ((), ())))
        maximal = [x[0] >= length and x[1] > 1 and (x[2] < 0 or x[2] != x[3]) for x in nodes]
        names: dict[int, str] = {}

        def named(k: int) -> tuple[int, str | None]:
            """The deepest maximal repeat from node k up, and its name."""
            while k > 0 and not maximal[k]:
                k = nodes[k][4]
            if k <= 0:
                return 0, None
            if k not in names:
                names[k] = xxhash.xxh3_128_hexdigest(bytes(suffixes[nodes[k][5]][: nodes[k][0]]))
            return k, names[k]

        columns = ["name", "length", "copies", "parent"]
        own, rows = [], []
        for row, k in enumerate(deepest):
            k, name = named(k)
            if name:
                own.append((name, nodes[k][0], nodes[k][1], None))
                rows.append(row)
        members = pd.concat([pd.DataFrame(own, columns=columns), pdf[["r", "d", "p", "o", "n"]].iloc[rows].reset_index(drop=True).astype("Int64")], axis=1)
        tree = [(named(k)[1], x[0], x[1], named(x[4])[1]) for k, x in enumerate(nodes) if maximal[k] and x[5] >= 0]
        return pd.concat([members, pd.DataFrame(tree, columns=columns).reindex(columns=members.columns).astype({c: "Int64" for c in members.columns[4:]})])

    return run


def _digest(texts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for t, u, zipped, spans in pdf[["t", "u", "zipped", "spans"]].itertuples(index=False):
                text, at, kept, runs = unzip.decompress(zipped), 0, [], 0
                for a, b in sorted((s["p"], s["e"]) for s in spans) if spans is not None else ():
                    if a > at or not runs:
                        kept.append(text[at:a])
                        runs += 1
                    at = max(at, b)
                rest = b"".join([*kept, text[at:]])
                rows.append((t, u, len(text), len(text) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace") if texts else None))
            yield pd.DataFrame(rows, columns=["t", "u", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _several(rows: DataFrame, weight: Column) -> DataFrame:
    """The keys that stand for more than one row. They are written, for only a join of two plain shuffles can be split where a key is very common."""
    return staged(rows.groupBy("key").agg(weight.alias("_n")).filter("_n > 1").select("key"), "several")


class Repeats:
    """The maximal repeats of all texts of docs, of `length` bytes or more.

    Equal texts are one text with a number of copies. Windows of `length` bytes are told apart by their least seed of `seed` bytes,
    which picks one place in about length / 2; of these places only those go on whose half a window comes again. Each is a stretch of text
    that all its windows make up, at most two lengths long. Equal stretches are one, with its copies. Where stretches share a half but differ,
    suffixes are taken where a window repeats and the bytes before it vary (or the stretch begins): a sparse suffix array, sorted by ranges of the
    suffixes themselves, so that no common string needs one task. A stack scan over each piece of it, with what its
    neighbours have in common with its edges, gives the tree of common-prefix intervals; those whose preceding bytes vary are
    the maximal repeats. Repeats that are longer than a stretch come as overlapping pieces.
    """

    def __init__(self, docs: DataFrame, length: int = 200, seed: int = 24):
        if not 0 < seed <= length // 2 or length >= 1 << 15:
            raise ValueError("a seed has at most half the length, and a length less than 2 ** 15 bytes")
        self.length = length
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        t, u = row_key(text)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t"), u.alias("u"), text.alias("text"))
        own = self.docs.select("t", "u", _zipped("text").alias("zipped")).groupBy("t", "u").agg(F.count("*").alias("n"), F.first("zipped").alias("zipped"))
        #: The different texts; d is a number that stands for one, from here on.
        self.texts = staged(own.withColumn("d", F.monotonically_increasing_id()), "texts")
        runs = staged(self.texts.mapInPandas(_runs(length, seed), "key long, b long, d long, n long, v long"), "runs")
        #: Stretches of text around halves that come again, and the different ones with the number of their copies.
        again = _several(runs, F.sum("n"))
        self.stretches = staged(runs.join(again, "key"), "stretches")
        dropped(runs, again)
        classes = self.stretches.groupBy("key", "b").agg(F.sum("n").alias("n"), F.first(F.struct("d", "v")).alias("at"))
        self.classes = staged(classes.select("key", "b", "n", "at.*").withColumn("r", F.monotonically_increasing_id()), "classes")
        self.mixed = _several(self.classes, F.count("*"))
        array = self._array()
        self.members = staged(self._tree(array), "members")
        dropped(array)

    def _array(self) -> DataFrame:
        """Sorted suffixes of single stretches that start where a window repeats and the bytes before it vary, by pieces, with an edge row a piece.

        Windows are told by their hashes here, which can only add suffixes: the suffix array compares bytes.
        """
        found = self.classes.join(self.mixed, "key").groupBy("d").agg(F.collect_list(F.struct("r", "n", "v")).alias("found"))
        schema = "r long, n long, d long, p long, stretch binary, w array<long>, left array<short>"
        single = staged(self.texts.select("d", "zipped").join(found, "d").mapInPandas(_windows(self.length), schema), "single")
        window = single.select("r", "n", F.posexplode(F.arrays_zip("w", "left")).alias("o", "x")).select("r", "n", "o", "x.*")
        names = window.groupBy("w").agg(F.sum("n").alias("_n"), F.min("left").alias("low"), F.max("left").alias("high"))
        names = staged(names.filter("_n > 1 and (low < 0 or low <> high)").select("w"), "names")
        starts = window.select("r", "w", "o", "left").join(names, "w").groupBy("r").agg(F.collect_list(F.struct("o", "left")).alias("starts"))
        own = single.drop("w", "left").join(starts, "r").select("*", F.explode("starts").alias("x"))
        own = own.select("r", "n", "d", (F.col("p") + F.col("x.o")).alias("p"), F.col("x.o").cast("long").alias("o"), F.col("x.left").cast("int").alias("left"), F.expr("substring(stretch, x.o + 1)").alias("suffix"))
        order = ["suffix", "r", "o"]
        group = "array<array<long>>"
        schema = f"r long, n long, d long, p long, o long, left int, suffix binary, part int, i long, common int, front {group}, back {group}, whole binary"
        array = staged(own.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_arrayed(self.length), schema), "array")
        dropped(single, names)
        return array

    def _tree(self, array: DataFrame) -> DataFrame:
        """Maximal repeats and members of all pieces."""
        edges = [r.asDict() for r in array.filter("i < 0").select("part", "suffix", "whole", "common", "front", "back").collect()]  # one row a task, two stretches each
        rows = array.filter("i >= 0").drop("front", "back", "whole")
        schema = "name string, length int, copies long, parent string, r long, d long, p long, o long, n long"
        return rows.groupBy("part").applyInPandas(_scanned(self.length, outside(edges, self.length)), schema)

    def groups(self) -> DataFrame:
        """(name, length, copies, parent): the maximal repeats; parent is the next shorter one that it starts with, if any."""
        tree = self.members.filter("r is null").select("name", "length", "copies", "parent").distinct()
        return tree.unionByName(self._alone().select("name", "length", F.col("n").alias("copies"), F.lit(None).cast("string").alias("parent")))

    def _alone(self) -> DataFrame:
        """Stretches with copies that no other stretch shares a half with."""
        mixed = self.mixed.withColumn("_mixed", F.lit(True))
        own = self.classes.filter("n > 1").join(mixed, "key", "left").filter("_mixed is null")
        return own.withColumn("name", F.concat(F.hex("key"), F.lit("-"), F.hex("b"))).withColumn("length", (F.col("v").bitwiseAND(0xFFFF) + self.length - 1).cast("int"))

    def occurrences(self) -> DataFrame:
        """(name, doc_id, start): where the repeats stand, each place under the longest one that starts there; it belongs to the parents too."""
        own = self.members.filter("r is not null").select("name", "r", "o").join(self.classes.select("r", "key", "b"), "r").drop("r")
        own = own.unionByName(self._alone().select("name", "key", "b", F.lit(0).cast("long").alias("o")))
        place = self.stretches.select("key", "b", "d", F.shiftright("v", 16).alias("first"))
        placed = own.join(place, ["key", "b"]).select("name", "d", (F.col("first") + F.col("o")).alias("start"))
        docs = self.docs.select("doc_id", "t", "u").join(self.texts.select("t", "u", "d"), ["t", "u"])
        return placed.join(docs, "d").select("name", "doc_id", "start")

    def covered(self) -> DataFrame:
        """(d, spans): for each text with repeats, the bytes p to e of them."""
        end = F.shiftright("v", 16) + F.col("v").bitwiseAND(0xFFFF) - 1 + self.length
        again = self.stretches.join(self.classes.filter("n > 1").select("key", "b"), ["key", "b"])
        spans = again.select("d", F.struct(F.shiftright("v", 16).alias("p"), end.alias("e")).alias("s"))
        single = self.members.filter("n = 1").select("d", F.struct("p", (F.col("p") + F.col("length")).alias("e")).alias("s"))
        return spans.unionByName(single).groupBy("d").agg(F.collect_set("s").alias("spans"))

    def removed(self, texts: bool = True) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for every row of docs. See removed()."""
        joined = self.texts.join(self.covered(), "d", "left").select("t", "u", "zipped", "spans")
        done = staged(joined.mapInPandas(_digest(texts), "t long, u long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"), "digests")
        return self.docs.select("doc_id", "t", "u").join(done, ["t", "u"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def removed(docs: DataFrame, length: int = 200, seed: int = 24, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null unless texts) for every row of docs.

    Texts are UTF-8; each byte under a string of `length` bytes that also starts anywhere else (in any row, the same one included)
    goes: these are the bytes of the maximal repeats. What is kept may not be UTF-8, so kept has replacement characters
    there. Whole texts count; null texts are empty. Repeated rows, and rows of equal texts, repeat each other. An empty table gives an
    empty result; other columns are not read.
    """
    return Repeats(docs, length, seed).removed(texts)
