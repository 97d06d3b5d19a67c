"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick over folded text.

The lexicon, its exception phrases and the calibration are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.llm.common import staged

# Characters that stand for a Latin letter by shape, and digits or signs used in its place.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ſ": "s", "ƅ": "b", "ɩ": "i",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
HIDDEN = "­​‌‍⁠﻿"

_SHAPES = str.maketrans({**HOMOGLYPHS, **{chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)}, **dict.fromkeys(HIDDEN)})
_SWAPS = str.maketrans(SUBSTITUTIONS)
_SWAPPED = re.compile(r"(?=[0134578@$!|]*[^\W\d_])[^\W_@$!|]*[0134578@$!|][\w@$!|]*(?<=[\w@$])")
_GAPS = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """Lower-cased words between single spaces, with a space at both ends; look-alikes and digits in words become letters."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = text.translate(_SHAPES)
    text = _SWAPPED.sub(lambda m: m[0].translate(_SWAPS), text)
    return f" {_GAPS.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """terms: ' word ' or ' stem' with weight; exceptions: ' two words ' that void a hit inside them; betas: the logistic fit."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    betas: tuple[float, float, float, float] = (-4.0, 0.0, 1.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for t, w in self.terms.items():
            found.add_word(t, (len(t), w))
        for t in self.exceptions:
            found.add_word(t, (len(t), None))
        if len(found):
            found.make_automaton()
        return found


def hits_of(automaton, text: str) -> dict[int, float]:
    """Weight of the best term for each word (by its start) that a term hits and no exception phrase covers."""
    hits: dict[int, float] = {}
    if not len(automaton):
        return hits
    void: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(text):
        at = end - n + 1
        if w is None:
            void.append((at, end))
        elif w > hits.get(at, -math.inf):
            hits[at] = w
    for lo, hi in void:
        for at in [a for a in hits if lo <= a < hi]:
            del hits[at]
    return hits


def features(hits: dict[int, float], text: str) -> tuple[float, float, float]:
    """Logarithms of weighted hits per thousand words, of weighted hits, and of the hits beyond the first."""
    if not hits:
        return 0.0, 0.0, 0.0
    total = sum(hits.values())
    return math.log1p(1000.0 * total / (text.count(" ") - 1)), math.log1p(total), math.log1p(len(hits) - 1)


def judged(texts, automaton, betas: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Scores and numbers of hits."""
    rows = np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        text = folded(text)
        hits = hits_of(automaton, text)
        rows[i] = *features(hits, text), len(hits)
    return 1 / (1 + np.exp(-(betas[0] + rows[:, :3] @ np.array(betas[1:])))), rows[:, 3]


def _labelled(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """A bounded sample (text, toxic) of the labelled rows that may be learned from, taken by a hash of the id."""
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    own = own.filter("_id is not null and _toxic in (0, 1) and crc32(cast(_id as string)) % 4 != 2").dropDuplicates(["_id"])
    part = [own.filter(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(n) for k, n in ((1, most_toxic), (0, most_clean))]
    ids = F.broadcast(part[0].unionByName(part[1]))  # at most most_toxic + most_clean rows
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(ids, "_id").select("text", "_toxic")


def _terms(stems: tuple[int, ...]):
    """Per batch of texts, for each word and word stem: toxic and clean documents, those with it twice, toxic and clean
    occurrences, and, of the toxic ones, marks of the words before and of the words themselves. Row '' has all words."""

    def count(texts: list[str], labels: list[int]) -> pd.DataFrame:
        found: dict[str, list] = {"": [0] * 6 + [None, None]}
        for text, toxic in zip(texts, labels, strict=True):
            own: dict[str, list] = {}
            before, words = "", folded(text).split()
            for word in words:
                for term in (f" {word} ", *[f" {word[:n]}" for n in stems if len(word) > n]):
                    own.setdefault(term, [0, before, word])[0] += 1
                before = word
            found[""][3 - toxic] += len(words)
            for term, (n, mark, word) in own.items():
                row = found.setdefault(term, [0] * 6 + [None, None])
                row[1 - toxic] += 1
                row[3 - toxic] += n
                row[5 - toxic] += n > 1
                if toxic:
                    if row[6] is None:
                        row[6], row[7] = set(), set()
                    row[6].add(zlib.crc32(mark.encode()))
                    row[7].add(zlib.crc32(word.encode()))
        return pd.DataFrame([(k, *v[:6], list(v[6] or ()), list(v[7] or ())) for k, v in found.items()], columns=_COUNTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 200):
                yield count(pdf["text"].tolist()[i : i + 200], pdf["_toxic"].tolist()[i : i + 200])

    return run


_COUNTS = ["term", "toxic", "clean", "times_toxic", "times_clean", "twice_toxic", "twice_clean", "marks", "kinds"]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        beta += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * beta), -2, 2)
    return beta


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_clean: int = 4000, evidence: float = 24.0, stems: tuple[int, ...] = (4, 5, 6)) -> Lexicon:
    """Learn a lexicon from at most most_toxic + most_clean labelled rows whose crc32(doc_id) mod 4 is not 2.

    A term is a word, or a stem that starts three words or more. It enters if a likelihood-ratio statistic of at least
    `evidence` (about one in a million by chance) ties it, or it twice, to toxic rows; its toxic rows count at most once for
    each different word before it, so that copied passages are no evidence. Its weight is the log ratio of its rates in toxic
    and clean words. Pairs of words around a hit that only clean rows show (two at least) become exception phrases. A ridge
    logistic fit turns hits into a score. The size of the lexicon is bounded by the words of the sample. Labels of null
    doc_ids or other values say nothing; no usable labels, or empty tables: no terms.
    """
    sample = staged(_labelled(docs, labels, most_toxic, most_clean), "labelled")
    sizes = {r[0]: r[1] for r in sample.groupBy("_toxic").count().collect()}
    nt, nc = sizes.get(1, 0), sizes.get(0, 0)
    if not nt or not nc:
        return Lexicon({})
    counts = sample.mapInPandas(_terms(stems), "term string, toxic long, clean long, times_toxic long, times_clean long, twice_toxic long, twice_clean long, marks array<long>, kinds array<long>").groupBy("term")
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    counts = staged(counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.sum("times_toxic").alias("ot"), F.sum("times_clean").alias("oc"), distinct("marks").alias("m"), distinct("kinds").alias("kinds"), F.sum("twice_toxic").alias("t2"), F.sum("twice_clean").alias("c2")), "terms")
    words = counts.filter("term = ''").first()
    share = nt / (nt + nc)

    def evidence_of(t, c):
        """Likelihood ratio of t toxic and c clean rows against the share of toxic rows; 0 if they are fewer than that share."""
        n = t + c
        part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
        return F.when(t > n * share, 2 * (part(t, n * share) + part(c, n * (1 - share)))).otherwise(0.0)

    usable = counts.filter("term != '' and t >= 3 and (term like '% ' or kinds >= 3)")
    usable = usable.withColumns({"t": F.least("t", "m").cast("double"), "c": F.col("c").cast("double"), "t2": F.least("t2", "m").cast("double"), "c2": F.col("c2").cast("double")})
    usable = usable.withColumn("llr", F.greatest(evidence_of(F.col("t"), F.col("c")), evidence_of(F.col("t2"), F.col("c2"))))
    usable = usable.withColumn("w", F.log((F.col("ot") + 0.5) / (F.col("oc") + 0.5) * F.lit((words["oc"] + 1) / (words["ot"] + 1))))
    best = usable.filter((F.col("llr") >= evidence) & (F.col("w") >= 1.0)).orderBy(F.desc("llr"), "term")
    lexicon = Lexicon({r["term"]: float(r["w"]) for r in best.collect()})
    if not lexicon.terms:
        return lexicon

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for pdf in batches:
            rows = []
            for text, toxic in zip(pdf["text"], pdf["_toxic"], strict=True):
                text, own = folded(text), set()
                for at in hits_of(automaton, text):
                    end = text.index(" ", at + 1)
                    if at:
                        own.add(text[text.rindex(" ", 0, at) : end + 1])
                    if end + 1 < len(text):
                        own.add(text[at : text.index(" ", end + 1) + 1])
                rows += [(p, toxic) for p in own]
            yield pd.DataFrame(rows, columns=["phrase", "toxic"])

    seen = sample.mapInPandas(phrases, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    lexicon.exceptions = sorted(r[0] for r in seen.filter("t = 0 and n >= 2").collect())

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for pdf in batches:
            texts = [folded(t) for t in pdf["text"]]
            x = np.array([features(hits_of(automaton, t), t) for t in texts]).reshape(-1, 3)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": pdf["_toxic"].astype(float)})

    rows = np.array([tuple(r) for r in sample.mapInPandas(measured, "a double, b double, c double, y double").collect()])  # bounded by the sample
    beta = _logistic(np.column_stack([np.ones(len(rows)), rows[:, :3]]), rows[:, 3], ridge=0.1)
    lexicon.betas = (float(beta[0]), *(float(b) for b in beta[1:]))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on), n_hits for every row of docs.

    Whole texts are read. Null and empty texts have no hits. Repeated rows are scored alike, each in its own row; a null
    doc_id stays null (held_out null). An empty table gives an empty result. Only doc_id and text are read.
    """

    @F.pandas_udf("score double, n_hits long")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for texts in parts:
            score, n = judged(texts, automaton, lexicon.betas)
            yield pd.DataFrame({"score": score, "n_hits": n.astype("int64")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), judge(F.col("text").cast("string")).alias("j"))
    return rows.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), F.col("j.score").alias("score"), (F.col("j.score") >= threshold).cast("int").alias("predicted"), F.col("j.n_hits").alias("n_hits"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, columns unchanged, whose score stays under the threshold.

    Null and empty texts stay, as do null doc_ids and repeated rows; an empty table stays empty.
    """

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in parts:
            yield pd.Series(judged(texts, automaton, lexicon.betas)[0] < threshold)

    return docs.filter(clean(F.col("text").cast("string")))
