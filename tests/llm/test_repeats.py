"""Maximal repeats and their removal against brute force: pieces of the suffix array, hot passages, nulls, long and repetitive texts."""

import collections
import hashlib
import random

import pandas as pd
import pytest
import zstandard

from utxolens.llm import repeats


def by_hand(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone, end = bytearray(len(d)), 0
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[max(i, end) : i + length] = b"\1" * (i + length - max(i, end))
                end = i + length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), len(d) - len(kept), gone.replace(b"\1\0", b"\1 ").count(b" ") + gone.endswith(b"\1"), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    dice = random.Random(seed)
    line = lambda k: "".join(dice.choice("abcdefgh é漢\n") for _ in range(k))
    hot, other = line(40), line(25)
    out = [None, "", "short", "aaaa" * 300, "ab" * 500, hot, hot + hot]
    for i in range(n):
        text = line(dice.randint(0, 90))
        if i % 3 == 0:
            text += hot[dice.randint(0, 8) :] + line(dice.randint(0, 30))
        if i % 7 == 0:
            text = other + text + hot[: dice.randint(10, 40)]
        out.append(text)
    return out + [out[20], out[20], out[30][:-3], "x" + out[30], line(6000) + hot * 3]


@pytest.mark.parametrize("length, seed", [(12, 3), (20, 8), (31, 15)])
def test_removed_bytes_against_brute_force(spark, length, seed):
    texts = corpus(length)
    rows = [(i, t, "x", "x", "x") for i, t in enumerate(texts)] + [(None, texts[25], "x", "x", "x"), (5, texts[40], "x", "x", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string, key string, n string")
    got = repeats.removed(docs, length, seed)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    want = by_hand([r[1] for r in rows], length)
    assert sorted(map(repr, (tuple(r)[:5] for r in got.collect()))) == sorted(map(repr, ((r[0], *w) for r, w in zip(rows, want, strict=True))))


def test_empty_table_and_bad_parameters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.removed(docs).collect() == [] and repeats.Repeats(docs).groups().collect() == [] and repeats.Repeats(docs).occurrences().collect() == []
    for length, seed in ((10, 6), (1 << 15, 3), (10, 0)):
        with pytest.raises(ValueError):
            repeats.removed(docs, length, seed)


def test_long_texts_are_read_by_segments():
    dice = random.Random(9)
    texts = [bytes(dice.choice(b"abcd") for _ in range(k)) for k in (30_000, 19, 0, 20, 25, 500)]
    press = zstandard.ZstdCompressor()
    frame = pd.DataFrame({"d": range(6), "n": 1, "zipped": [press.compress(t) for t in texts]})
    whole = {}
    for segment in (1 << 20, 1000, 64):
        own, keys, hashes = {}, collections.defaultdict(set), {}
        for row in pd.concat(list(repeats._runs(20, 4, segment)(iter([frame.iloc[:2], frame.iloc[2:]])))).itertuples():
            first, number = row.v >> 16, row.v & 0xFFFF
            stretch = texts[row.d][first : first + number + 19]
            assert number > 0 and len(stretch) == number + 19 and hashes.setdefault(row.b, stretch) == stretch
            for i in range(number):
                assert (row.d, first + i) not in own
                own[row.d, first + i] = row.key
                keys[stretch[i : i + 20]].add(row.key)
        assert len(own) == sum(max(0, len(t) - 19) for t in texts) and all(len(k) == 1 for k in keys.values())
        assert whole.setdefault("keys", own) == own


def test_groups_have_all_their_occurrences(spark):
    """Each name stands for one string, its copies and occurrences with those of its children are all places of the string."""
    texts = [t for t in corpus(5, 90) if t]
    found = repeats.Repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 16, 5)
    groups = {r["name"]: r for r in found.groups().collect()}
    assert len(groups) == found.groups().count()
    places = collections.defaultdict(set)
    for name, doc, start in found.occurrences().collect():
        while name:
            places[name].add((doc, start))
            name = groups[name]["parent"]
    data = [t.encode() for t in texts]
    several = 0
    for name, r in groups.items():
        strings = {data[doc][start : start + r["length"]] for doc, start in places[name]}
        assert len(strings) == 1 and len(strings.pop()) == r["length"] >= 16
        assert len(places[name]) == r["copies"] > 1
        several += r["parent"] is not None
    assert several > 0


def plain_tree(rows, length):
    """name -> (copies, varies to the left) of every common prefix of rows where they part."""
    out = {}
    for i, (a, *_) in enumerate(rows):
        sizes = {repeats._common(a, b) for j, (b, *_) in enumerate(rows) if j != i} | ({len(a)} if rows[i][1] > 1 else set())
        for k in sizes:
            if k >= length:
                own = [r for r in rows if r[0][:k] == a[:k]]
                out[a[:k]] = (sum(r[1] for r in own), min(r[2] for r in own), max(r[2] for r in own))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_pieces_of_the_suffix_array_make_the_whole_tree(seed):
    dice = random.Random(seed)
    rows = sorted((b"abc"[: dice.randint(2, 3)] + bytes(dice.choice(b"ab") for _ in range(dice.randint(3, 7))), dice.choice([1, 1, 1, 3]), dice.choice([-1, 97, 98])) for _ in range(dice.randint(1, 60)))
    cuts = sorted({0, len(rows), *(dice.randint(0, len(rows)) for _ in range(dice.randint(0, 8)))})
    edges, pieces = [], {}
    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        frame = pd.DataFrame({"suffix": [r[0] for r in rows[a:b]], "n": [r[1] for r in rows[a:b]], "left": [r[2] for r in rows[a:b]]})
        out = pd.concat(list(repeats._arrayed(4, lambda part=part: part)(iter([frame.iloc[:3], frame.iloc[3:]]))))
        edges += out[out["i"] < 0][["part", "suffix", "whole", "common", "front", "back"]].to_dict("records")
        pieces[part] = out[out["i"] >= 0]
    around, got, deepest = repeats.outside(edges, 4), {}, []
    for part, p in pieces.items():
        suffixes = p["suffix"].tolist()
        nodes, own = repeats.interval_tree(p["common"].tolist(), p["n"].tolist(), p["left"].tolist(), list(map(len, suffixes)), 4, *around.get(part, ((), ())))
        for size, *stats, _, row in nodes[1:]:
            if row >= 0:
                assert got.setdefault(suffixes[row][:size], tuple(stats)) == tuple(stats)
        deepest += [nodes[k][0] if k > 0 else 0 for k in own]
    want = plain_tree(rows, 4)
    assert got == want
    assert deepest == [max((k for k in range(4, len(r[0]) + 1) if r[0][:k] in want), default=0) for r in rows]
