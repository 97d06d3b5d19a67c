"""Best-two-fit packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import json
import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.llm.common import dealt_rank, staged

_MARK = b"\x01"
# The form of tokenizer files whose ids of a text are those of its chunks.
_CHUNKED_FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_ENCODERS: dict[str, object] = {}
_LATIN = frozenset([*range(0xA0, 0xB7), *range(0xB8, 0xC0)])  # second bytes of the lower-case letters U+00E0 to U+00FF


def _ends_word(chunk: bytes) -> bool:
    """True for a word and one full stop or comma, which is a token run of its own."""
    if chunk[-1] not in b".," or len(chunk) < 2:
        return False
    return chunk[-2:-1].isalnum() or (len(chunk) > 2 and chunk[-3] == 0xC3 and chunk[-2] in _LATIN)


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def chunks(text: str | None) -> list[bytes]:
    """White-space free chunks of a text, in a form that gives the same ids: ASCII in lower case.

    Texts with combining marks or with what looks like a special token are only split.
    """
    raw = text.encode("utf-8", "replace") if text else b""
    if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw:
        return raw.split()
    return raw.lower().split()


class ChunkEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit values, with a bounded memory of white-space free chunks.

    The tokenizer (byte-level BPE over runs of letters, single digits and runs of other signs; lower case; NFC) never joins
    characters across ASCII white space, so a text's ids are those of its chunks in a row. A new chunk of Latin letters is
    one run and goes to the BPE model itself; other new chunks are encoded together, a mark of one id between them. With a
    tokenizer file of any other form, whole texts are encoded.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        form = json.loads(Path(path).read_text())
        self.by_chunk = all(form.get(k) == v for k, v in _CHUNKED_FORM.items()) and form["model"]["type"] == "BPE" and not form["model"].get("dropout")
        mark = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.marks = {ord(c): self._ids(c).tobytes() for c in ".,"}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, new: list[bytes]) -> None:
        if len(self.known) + len(new) > self.most:
            self.known.clear()
        rest, ends = [], []
        for c in new:
            if _ends_word(c):
                ends.append(c)
                c = c[:-1]
                if c in self.known:
                    continue
            word = c.decode("utf-8", "replace")
            if word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word)):
                run = word.lower() if word.isascii() else word.lower().encode().decode("latin-1").translate(_LETTERS)
                ids = [t.id for t in self.tokenizer.model.tokenize(run)]
                self.known[c] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(c)
        plain = [c for c in rest if self.mark is not None and _MARK not in c]
        for i in range(0, len(plain), 400):
            part = plain[i : i + 400]
            ids = self._ids((b" " + _MARK + b" ").join(part).decode("utf-8", "replace"))
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                for c in part:
                    self.known[c] = self._ids(c.decode("utf-8", "replace")).tobytes()
                continue
            for c, own in zip(part, np.split(ids, cuts), strict=True):
                self.known[c] = (own[1:] if c is not part[0] else own).tobytes()
        for c in set(rest) - set(plain):
            self.known[c] = self._ids(c.decode("utf-8", "replace")).tobytes()
        for c in ends:
            self.known[c] = self.known[c[:-1]] + self.marks[c[-1]]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        if not self.by_chunk:
            yield from (self._ids(t or "").tobytes() for t in texts)
            return
        for i in range(0, len(texts), 64):
            split = [chunks(t) for t in texts[i : i + 64]]
            found = [list(map(self.known.get, words)) for words in split]
            fresh = {w for words, own in zip(split, found, strict=True) if None in own for w, ids in zip(words, own, strict=True) if ids is None}
            if fresh:
                self.learn(list(fresh))
            for words, own in zip(split, found, strict=True):
                if None in own:
                    own = [self.known[w] if ids is None else ids for w, ids in zip(words, own, strict=True)]
                yield b"".join(own)


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = 4 * capacity
        end = np.array([end_id], "<u4").tobytes()
        ids_of = encoder(path)
        for pdf in batches:
            rows = []
            for doc, ids in zip(pdf["doc_id"], ids_of.encode(pdf["text"].tolist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=pd.array(out["doc_id"], dtype="Int64"))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: times}, bins) that use up counts {length: items}; lengths are 1 to capacity.

    A bin takes the largest item that fits, again and again. Then its smallest item gives way to the two unpacked items that
    fill the widened gap best, if they fill it better. Equal bins are made at once, so the work depends on the number of
    different lengths alone, never on the number of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    plan = []
    while lengths:
        used: dict[int, int] = {}
        gap = capacity
        while (i := bisect_right(lengths, gap) - 1) >= 0:
            while i >= 0 and left[lengths[i]] - used.get(lengths[i], 0) <= 0:
                i -= 1
            if i < 0:
                break
            used[lengths[i]] = used.get(lengths[i], 0) + 1
            gap -= lengths[i]
        small = min(used)
        room = gap + small
        if gap:
            free = np.array([n for n in lengths[: bisect_right(lengths, room)] if left[n] > used.get(n, 0)])
            if len(free):
                twin = np.array([left[n] - used.get(n, 0) > 1 for n in free.tolist()])
                at = np.searchsorted(free, np.minimum(free, room - free), side="right") - 1
                at = np.where((at == np.arange(len(free))) & ~twin, at - 1, at)
                total = np.where(at >= 0, free + free[np.maximum(at, 0)], 0)
                total = np.where(total <= room, total, 0)
                if total.max() > small:
                    k = int(np.flatnonzero(total == total.max())[-1])
                    used[small] -= 1
                    for n in (int(free[k]), int(free[at[k]])):
                        used[n] = used.get(n, 0) + 1
                    used = {n: c for n, c in used.items() if c}
        times = min(left[n] // c for n, c in used.items())
        plan.append((used, times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del lengths[bisect_right(lengths, n) - 1]
    return plan


def _segments(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Per pattern and length: the ranks (among items of the length) that go there, the first bin, the bins, the place."""
    rows, taken, bins = [], {}, 0
    for used, times in plan:
        place = 0
        for n in sorted(used, reverse=True):
            first = taken.get(n, 0)
            rows.append((n, first, bins, times, place))
            taken[n] = first + used[n] * times
            place += n * used[n]
        bins += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "first", "bin", "times", "place"))}


def packed(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; only one longer than capacity is cut, into pieces of capacity. Null or empty text is
    the end id alone. Repeated rows and null doc_ids are packed like any others; other columns are not read; an empty
    table gives an empty result. The plan comes from the counts of the at most `capacity` lengths, the one thing that
    reaches the driver; pieces of a length are ranked over 256 buckets, so at most 256 * `capacity` sums place every piece.
    """
    made = staged(pieces(docs, path, capacity, end_id), "pieces")
    counts = {r[0]: r[1] for r in made.groupBy("length").agg(F.count("*")).collect()}  # at most `capacity` rows
    seg = _segments(best_two_fit(counts, capacity))
    key = seg["length"] * (1 << 48) + seg["first"]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(key, n * (1 << 48) + r, side="right") - 1
        inside = r - seg["first"][i]
        return pd.DataFrame({"sequence_id": seg["bin"][i] + inside % seg["times"][i], "offset": seg["place"][i] + inside // seg["times"][i] * n})

    ranked = dealt_rank(made, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), "rank", 256).withColumn("p", place("length", "rank"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("p.sequence_id").alias("sequence_id"), F.col("p.offset").alias("offset"))
