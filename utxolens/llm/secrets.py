"""Secret scans: plain patterns, and tokens that a battery of randomness tests, under false-discovery control by length, can't reject."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.llm.common import staged

# The plain patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": _DIGIT + "abcdef",
    "base32": _UPPER + "234567",
    "base36": _DIGIT + _LOWER,
    "BASE36": _DIGIT + _UPPER,
    "base62": _UPPER + _LOWER + _DIGIT,
    "base64": _UPPER + _LOWER + _DIGIT + "+/",
    "url64": _UPPER + _LOWER + _DIGIT + "-_",
}
# Where runs are cut, so that the parts of paths and compound names are tokens too.
_CUTS = [re.compile(f"[^{c}]{{16,}}") for c in ("/", "+", "_-", "/_-", "/+_-")]
_INDEX = {e: {c: i for i, c in enumerate(a)} for e, a in ALPHABETS.items()}
_SIGNS = _UPPER + _LOWER + _DIGIT + "+/-_"
_SYMBOLS = len(_SIGNS) + 1  # the last one stands for all other bytes
_SYMBOL_OF = np.full(256, _SYMBOLS - 1, np.int64)
_SYMBOL_OF[np.frombuffer(_SIGNS.encode(), np.uint8)] = np.arange(len(_SIGNS))


def encoding_of(token: str) -> str | None:
    """The narrowest encoding that can have written the token; None for words, numbers and mixtures."""
    chars = set(token)
    if chars <= set(_DIGIT) or token.isalpha() and (token.islower() or token[1:].islower() or token.isupper()):
        return None
    if chars <= set(_DIGIT + "abcdef") or chars <= set(_DIGIT + "ABCDEF"):
        return "hex"
    return next((e for e in ("base32", "base36", "BASE36", "base62", "base64", "url64") if chars <= set(ALPHABETS[e])), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    if df == 2:
        return math.exp(-x / 2)
    c = 2 / (9 * df)
    return 0.5 * math.erfc((((x / df) ** (1 / 3)) - (1 - c)) / math.sqrt(2 * c))


def _poisson_tail(k: int, mean: float) -> float:
    """The probability of k events or more."""
    if k <= 0:
        return 1.0
    if k > mean + 12 * math.sqrt(mean) + 40:
        return math.exp(max(-700.0, k - mean - k * math.log(k / mean)))  # Chernoff's bound
    term = below = math.exp(-mean)
    for i in range(1, k):
        term *= mean / i
        below += term
    return max(1e-16, 1.0 - below)


def _alphabet_p(values: np.ndarray, alphabet: str) -> float:
    """Chi-squared over single symbols; where they are expected under five times, the tail of its number of equal pairs, which rises with it,
    or chi-squared over upper case, lower case, digits and signs as four kinds: twice the smaller."""
    n, size = len(values), len(alphabet)
    seen = np.bincount(values, minlength=size)
    if n >= 5 * size:
        return _chi2_tail(float(((seen - n / size) ** 2 / (n / size)).sum()), size - 1)
    equal = _poisson_tail(int((seen * (seen - 1) // 2).sum()), n * (n - 1) / 2 / size)
    kind = np.array([0 if c in _UPPER else 1 if c in _LOWER else 2 if c in _DIGIT else 3 for c in alphabet])
    seen, expected = np.bincount(kind[values], minlength=4), n * np.bincount(kind, minlength=4) / size
    seen, expected = seen[expected > 0], expected[expected > 0]
    return min(1.0, 2 * min(equal, _chi2_tail(float(((seen - expected) ** 2 / expected).sum()), len(seen) - 1)))


def _runs_p(values: np.ndarray) -> float:
    """Runs above the median and not above it (Wald and Wolfowitz)."""
    high, n = values > np.median(values), len(values)
    a, b = int(high.sum()), int((~high).sum())
    if not a:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    return _normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 1.0


def _serial_p(values: np.ndarray) -> float:
    """Lag-one serial correlation of the symbol values about their mean."""
    centred, n = values - values.mean(), len(values)
    total = float((centred * centred).sum())
    return _normal_tail((float((centred[1:] * centred[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 2.0 ** (1 - n)


def battery(token: str, encoding: str) -> float:
    """Fisher's combination of the p-values of three tests that the symbols are uniform and independent: chi-squared, runs, serial correlation."""
    index = _INDEX[encoding]
    values = np.array([index[c] for c in (token.lower() if encoding == "hex" else token)])
    half = -sum(math.log(max(x, 1e-300)) for x in (_alphabet_p(values, ALPHABETS[encoding]), _runs_p(values), _serial_p(values)))
    return math.exp(-half) * (1 + half + half * half / 2)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain patterns, in order."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def merged(spans) -> tuple[list[int], list[int]]:
    """Begins and ends of what spans (start, kind, end), sorted by start, cover together."""
    begins: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of a run, and of each part of 16 characters or more that cuts at some of its signs leave, once each."""
    found = [(0, len(run))]
    if not run.isalnum():
        found += [m.span() for cut in _CUTS for m in cut.finditer(run)]
    return list(dict.fromkeys(found))


def tokens_of(text: str) -> tuple[list[tuple[int, int, int]], list[dict], list[int]]:
    """The plain spans of a text, its tokens outside them that some encoding may have written, and the lengths of the others.

    Parts overlap their runs.
    """
    base, tokens, others = base_spans(text), [], []
    begins, ends = merged(base)
    for m in _TOKEN.finditer(text):
        run = m[0].rstrip("=")
        for at, to in _parts(run):
            token, start, end = run[at:to], m.start() + at, m.end() if to == len(run) else m.start() + to
            if bisect_right(ends, start) < bisect_left(begins, end):
                continue
            if encoding := encoding_of(token):
                token = token.lower() if encoding == "hex" else token
                tokens.append({"s": start, "e": end, "encoding": encoding, "n": len(token), "token": token, "fit": battery(token, encoding)})
            else:
                others.append(len(token))
    return base, tokens, others


_SCAN = "base array<struct<s:long,k:int,e:long>>, tokens array<struct<s:long,e:long,encoding:string,n:int,token:string,fit:double>>, counts array<long>"
_CLASSES = 9


def _length_class(n: int) -> int:
    return min(_CLASSES - 1, int(math.log2(n)) - 3)


def _pairs(text: str) -> np.ndarray:
    symbols = _SYMBOL_OF[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    return np.bincount(symbols[:-1] * _SYMBOLS + symbols[1:], minlength=_SYMBOLS * _SYMBOLS)


def _scan(texts: pd.Series) -> pd.DataFrame:
    """Spans and tokens of each text. The first row of a batch also has the batch's counts: pairs of symbols of ordinary text,
    that is outside the plain spans and the tokens that the battery takes for random, then tokens by length class."""
    pairs, lengths, found = np.zeros(_SYMBOLS * _SYMBOLS, np.int64), [0] * _CLASSES, []
    for text in texts:
        text = text or ""
        base, tokens, others = tokens_of(text)
        pairs += _pairs(text)
        at = 0
        for a, b in sorted([(a, b) for a, _, b in base] + [(t["s"], t["e"]) for t in tokens if t["fit"] >= 0.001]):
            if b > at:
                pairs -= _pairs(text[max(a, at) : b])
                at = b
        for n in [*others, *(t["n"] for t in tokens)]:
            lengths[_length_class(n)] += 1
        found.append((base, tokens))
    out = pd.DataFrame({"base": [[{"s": a, "k": k, "e": b} for a, k, b in base] for base, _ in found], "tokens": [tokens for _, tokens in found]})
    out["counts"] = [pairs.tolist() + lengths if i == 0 else None for i in range(len(out))]
    return out


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities that ordinary text, inside runs of token characters, writes a symbol, and a symbol after another."""

    first: np.ndarray
    then: np.ndarray

    def evidence(self, token: str, encoding: str) -> float:
        """-log10 of the token's p-value against ordinary text: one over an e-value, 0 at least.

        The e-value is the likelihood ratio of uniform symbols of the encoding to ordinary text, over the number of encodings; under
        ordinary text it is 1 at most in the mean, and so its inverse is a p-value (Markov's inequality).
        """
        at = _SYMBOL_OF[np.frombuffer(token.encode(), np.uint8)]
        ratio = -len(at) * math.log(len(ALPHABETS[encoding])) - self.first[at[0]] - self.then[at[:-1], at[1:]].sum()
        return max(0.0, float(ratio - math.log(len(ALPHABETS))) / math.log(10))


def text_model(pairs: np.ndarray, prior: float = 50.0) -> TextModel:
    own = pairs[:-1, :-1].astype(float)
    first = pairs[:, :-1].sum(axis=0) + 1.0
    first /= first.sum()
    return TextModel(np.log(first), np.log((own + prior * first) / (own.sum(axis=1, keepdims=True) + prior)))


def thresholds(counts: dict[tuple[str, int], np.ndarray], tokens: dict[int, int], rate: float, step: float) -> dict[tuple[str, int], float]:
    """Benjamini-Hochberg in each family of one encoding and length class, on a grid of -log10 p.

    counts are a family's tokens by bin of evidence, tokens those of a length class in any encoding or none. With p-values
    that are inverse e-values it holds under any dependence between tokens.
    """
    out = {}
    for (encoding, length), n in counts.items():
        above = np.cumsum(n[::-1])[::-1]
        ok = np.flatnonzero((above > 0) & (10.0 ** (-step * np.arange(len(n))) * tokens[length] <= rate * above))
        out[encoding, length] = float(step * ok[0]) if len(ok) else math.inf
    return out


def rejected_from(counts: np.ndarray, level: float, step: float) -> float:
    """The least -log10 p, on a grid, at which the battery's p-values reject: Benjamini-Hochberg in one family; infinity for none.

    counts are the family's tokens by bin of -log10 p. Of the tokens rejected, `level` at most, in the mean, have uniform symbols.
    """
    above = np.cumsum(counts[::-1])[::-1]
    ok = np.flatnonzero((above > 0) & (10.0 ** (-step * np.arange(len(counts))) * counts.sum() <= level * above))
    return float(step * ok[0]) if len(ok) else math.inf


def doubt(fit: float, step: float, most: int) -> int:
    """The bin of a battery's p-value."""
    return min(int(-math.log10(max(fit, 1e-300)) / step), most)


@dataclass(frozen=True)
class Limits:
    """What decides which tokens are added: where the battery rejects, by family; then, as a filter, the model of all texts and the least evidence by family."""

    model: TextModel
    least: dict[tuple[str, int], float]
    rejected: dict[tuple[str, int], float]
    step: float = 0.1

    def uniform(self, t: dict) -> bool:
        """The battery does not reject the token."""
        return self.step * doubt(t["fit"], self.step, _DOUBTS) < self.rejected.get((t["encoding"], _length_class(t["n"])), math.inf)

    def chosen(self, tokens) -> list[dict]:
        """The tokens that pass, in order; of those that overlap the ones with the most evidence."""
        passed = []
        for t in tokens:
            if self.uniform(t):
                found = self.model.evidence(t["token"], t["encoding"])
                if found >= self.least.get((t["encoding"], _length_class(t["n"])), math.inf):
                    passed.append((-found, t["s"] - t["e"], t["s"], t))
        taken: list[tuple[int, int]] = []
        out: list[dict] = []
        for *_, t in sorted(passed, key=lambda x: x[:3]):
            at = bisect_left(taken, (t["s"], t["e"]))
            if (at == 0 or taken[at - 1][1] <= t["s"]) and (at == len(taken) or t["e"] <= taken[at][0]):
                insort(taken, (t["s"], t["e"]))
                out.append(t)
        return sorted(out, key=lambda t: t["s"])


_DOUBTS = 400


def _limits(rows: DataFrame, rate: float, level: float, step: float = 0.1) -> Limits:
    """Limits from scanned rows (base, tokens, counts)."""
    total = np.zeros(_SYMBOLS * _SYMBOLS + _CLASSES, np.int64)
    for at, n in rows.filter("counts is not null").select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect():  # 67 * 67 + 9 rows
        total[at] = n
    model = text_model(total[:-_CLASSES].reshape(_SYMBOLS, _SYMBOLS))
    most = int(400 / step)

    @F.pandas_udf("int")
    def weighed(token: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([min(int(model.evidence(*x) / step), most) for x in zip(token, encoding, strict=True)], dtype="int32")

    @F.pandas_udf("int")
    def doubted(fit: pd.Series) -> pd.Series:
        return pd.Series([doubt(x, step, _DOUBTS) for x in fit], dtype="int32")

    token = rows.select(F.explode("tokens").alias("t")).select("t.*")
    token = token.select("encoding", F.least(F.floor(F.log2("n")) - 3, F.lit(_CLASSES - 1)).cast("int").alias("length"), weighed("token", "encoding").alias("w"), doubted("fit").alias("d"))
    token = token.select("encoding", "length", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("w").alias("bin")), F.struct(F.lit(1).alias("kind"), F.col("d").alias("bin")))).alias("x")).groupBy("encoding", "length", "x.kind", "x.bin").count()
    counts: tuple[dict[tuple[str, int], np.ndarray], ...] = {}, {}
    for e, length, kind, b, n in token.collect():  # at most 7 encodings x 9 lengths x 4402 bins
        counts[kind].setdefault((e, length), np.zeros((_DOUBTS if kind else most) + 1))[b] += n
    return Limits(model, thresholds(counts[0], dict(enumerate(total[-_CLASSES:].tolist())), rate, step), {k: rejected_from(n, level, step) for k, n in counts[1].items()}, step)


def report(docs: DataFrame, rate: float = 0.001, level: float = 0.02) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of docs.

    A token of 16 characters or more outside the plain spans, in an inferred encoding, goes through the battery: are its symbols
    uniform, and independent of each other? Where its p-value rejects that, at a false-discovery rate of `level` among all tokens of its
    encoding and length class, it is out; so few random tokens are lost (the tests are not quite independent: three to five in a hundred at 0.02). What stays is filtered: ordinary text, by the pairs of symbols of all documents (plain
    spans and random-looking tokens aside), must be an unlikely writer of it, at a false-discovery rate of `rate` in its encoding and length
    class, where all tokens of the length count as tried. Runs with signs are tried whole and in parts.

    Null texts are empty; repeated rows and null doc_ids are rows like any others; an empty table gives an empty result;
    other columns are not read.
    """
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pandas_udf(_scan, _SCAN)(F.col("text").cast("string")).alias("x")).select("doc_id", "x.*"), "secrets")
    limits = _limits(rows, rate, level)

    @F.pandas_udf("array<struct<s:long,k:int,e:long>>")
    def added(tokens: pd.Series) -> pd.Series:
        return pd.Series([[{"s": t["s"], "k": 3, "e": t["e"]} for t in limits.chosen(own)] for own in tokens])

    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    found = rows.withColumn("added", F.when(F.size("tokens") > 0, added("tokens")).otherwise(none))
    name = F.array(*map(F.lit, KINDS))

    def text(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")

    def number(k):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    count = [number(k) for k in range(3)]
    return found.select("doc_id", *count, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_random"))


def masked(docs: DataFrame, mask: str = "[secret]", rate: float = 0.001, level: float = 0.02) -> DataFrame:
    """docs with every span that report() lists replaced by mask in text, and n_chars to match; no row goes, nulls stay.

    Texts are scanned once; only those with spans or tokens go through Python again. Columns of any name are kept; an empty
    table gives an empty result.
    """
    rows = staged(docs.select(F.struct(*docs.columns).alias("row"), F.pandas_udf(_scan, _SCAN)(F.col("text").cast("string")).alias("x")).select("row", "x.*"), "scanned")
    limits = _limits(rows, rate, level)

    @F.pandas_udf("string")
    def hide(texts: pd.Series, bases: pd.Series, tokens: pd.Series) -> pd.Series:
        out = []
        for text, base, own in zip(texts, bases, tokens, strict=True):
            if text:
                at, parts = 0, []
                for a, b in sorted([(x["s"], x["e"]) for x in base] + [(t["s"], t["e"]) for t in limits.chosen(own)]):
                    if b > at:
                        parts += [text[at : max(a, at)], mask if a >= at else ""]
                        at = b
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    own = F.when(F.size("base") + F.size("tokens") > 0, F.col("row.text").cast("string"))
    text = F.coalesce(hide(own, "base", "tokens"), F.col("row.text").cast("string"))
    out = rows.select(text.alias("_text"), "row").select(*[F.col("_text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
