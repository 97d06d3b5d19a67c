"""Fill-in-middle: lines of a text are counted by content-defined chunks, whose summaries are memoised, and cut at two of them."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 17) for b in range(256)], np.uint32)
_REACH = 32  # bytes that a rolling hash of 32 bits depends on


def rolled(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: the sum of the last 32 bytes' numbers, the k-th last one shifted by k bits."""
    h, span = _GEAR[data], 1
    while span < _REACH:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    return h


def chunk_ends(text: bytes, bits: int = 9, least: int = 64, most: int = 4096, segment: int = 1 << 20) -> list[int]:
    """Ends of chunks: where the top `bits` of the rolling hash are zero, `least` to `most` bytes apart.

    The hash is taken a segment at a time, so that a text of any length needs a few MB.
    """
    ends, last, n = [], 0, len(text)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, n, segment):
        low = max(0, at - _REACH + 1)
        marks = np.flatnonzero(rolled(data[low : at + segment])[at - low :] >> np.uint32(32 - bits) == 0) + at + 1
        for end in marks.tolist():
            while end - last > most:
                last += most
                ends.append(last)
            if end - last >= least:
                ends.append(end)
                last = end
    while n - last > most:
        last += most
        ends.append(last)
    return [*ends, n] if n > last else ends


@dataclass(frozen=True)
class Summary:
    """What a chunk adds to any text: where lines end in it (offsets after the line feed), its code points, whether its last line stays open."""

    line_ends: np.ndarray
    chars: int
    is_open: bool


def code_points(data: bytes) -> int:
    return len(data) - int(((np.frombuffer(data, np.uint8) & 0xC0) == 0x80).sum())


def summarised(chunk: bytes) -> Summary:
    ends = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10) + 1
    return Summary(ends.astype(np.int32), code_points(chunk), not chunk.endswith(b"\n"))


class Memo:
    """Summaries by chunk hash, each with its content: a chunk gets a stored summary only if its bytes are equal.

    At most `room` bytes of chunks are held; the ones used longest ago go first, which costs time and changes nothing.
    """

    def __init__(self, room: int = 32 << 20):
        self.room, self.held, self.hits, self.found = room, 0, 0, {}

    def summary(self, chunk: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(chunk)
        entry = self.found.pop(key, None)
        if entry and entry[0] == chunk:
            self.hits += 1
        else:
            self.held += len(chunk) - (len(entry[0]) if entry else 0)
            entry = chunk, summarised(chunk)
        self.found[key] = entry
        while self.held > self.room and len(self.found) > 1:
            oldest = next(iter(self.found))
            self.held -= len(self.found.pop(oldest)[0])
        return entry[1]


class Lines:
    """The lines of a text by the summaries of its chunks."""

    def __init__(self, text: bytes, memo: Memo):
        self.text, self.ends = text, chunk_ends(text)
        self.starts = [0, *self.ends[:-1]]
        self.parts = [memo.summary(text[a:b]) for a, b in zip(self.starts, self.ends, strict=False)]
        self.closed = np.cumsum([len(p.line_ends) for p in self.parts]).tolist()
        self.chars = [0, *np.cumsum([p.chars for p in self.parts]).tolist()]
        self.n = (self.closed[-1] + self.parts[-1].is_open) if self.parts else 0

    def cut(self, lines: int) -> tuple[int, int]:
        """Bytes and code points of the first `lines` lines."""
        if lines == 0:
            return 0, 0
        k = bisect_left(self.closed, lines)
        if k == len(self.closed):  # the last line, which no line feed ends
            return len(self.text), self.chars[-1]
        part = self.parts[k]
        at = int(part.line_ends[lines - 1 - (self.closed[k] - len(part.line_ends))])
        return self.starts[k] + at, self.chars[k] + code_points(self.text[self.starts[k] : self.starts[k] + at])


def draws(doc_id: int | None, seed: int) -> list[int]:
    own = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{own}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def infilled(text: bytes, doc_id: int | None, memo: Memo, rate: int = 100, spm: int = 50, seed: int = 7) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle, and the output of one text."""
    own, h = Lines(text, memo), draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return own.n, "plain", None, None, text
    (a, a_chars), (b, b_chars) = (own.cut(k) for k in sorted(x % (own.n + 1) for x in h[:2]))
    if h[3] % 100 < spm:
        return own.n, "spm", a_chars, b_chars - a_chars, b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return own.n, "psm", a_chars, b_chars - a_chars, b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def restored(output: bytes, form: str) -> bytes:
    """The text of an output, from nothing but the output and its form."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    x, _, rest = output.removeprefix(first).partition(second)
    y, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (x, y) if form == "psm" else (y, x)
    return prefix + middle + suffix


def transformed(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, texts: bool = True, room: int = 32 << 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output (null unless texts) for every row of docs.

    Units are lines with their line feeds. Two cuts come from a hash of seed and doc_id; `rate` of a hundred documents are
    transformed, `spm` of a hundred of these with the suffix first. Each task cuts whole texts of any length into chunks by
    content and keeps the summaries of up to `room` bytes of them, so that copies and common passages are counted once a task.
    Null and empty texts, and texts with a mark in them, stay plain. Rows are independent: nothing is shuffled, repeated rows
    come out repeated, a null doc_id draws by the seed alone, an empty table gives an empty result, other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(room)
        for pdf in batches:
            rows = []
            for doc, known, text in zip(pdf["d"], pdf["known"], pdf["text"], strict=True):
                n, form, prefix, middle, output = infilled((text or "").encode("utf-8", "surrogatepass"), int(doc) if known else None, memo, rate, spm, seed)
                back = hashlib.sha256(restored(output, form)).hexdigest()
                rows.append((int(doc) if known else None, n, form, prefix, middle, hashlib.sha256(output).hexdigest(), back, output.decode("utf-8", "replace") if texts else None))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"])
            yield out.astype({c: "Int64" for c in ("doc_id", "prefix_chars", "middle_chars")})

    doc = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc, F.lit(0)).alias("d"), doc.isNotNull().alias("known"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string")
