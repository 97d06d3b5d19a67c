"""Corpus operators against brute force on small fixtures, with nulls, empty texts, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from utxolens.llm import mixing, packing, secrets, sharding, simhash, substrings, topk, toxicity, urls, vectors
from utxolens.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, k1 string, h string, label string, size string, d string, shard string"


def frame(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, s in rows], DOC)


def corpus(n=60, seed=5):
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(dice.choices(words, k=dice.randint(0, 120))), f"s{i % 4}") for i in range(n)]
    passage = " ".join(dice.choices(words, k=60))
    rows += [(n + i, f"{rows[i][1]} {passage} end{i}", "s0") for i in range(8)]
    rows += [(n + 20, rows[3][1], None), (n + 21, None, "s1"), (n + 22, "", "s1"), (None, "lost \t\n row", "s2"), (None, None, None), (n + 23, "ab " * 500, "s3")]
    return rows + [rows[0], rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


def words(text):
    return (text or "").encode().split()


def test_toxicity_learns_stems_and_folds(spark):
    dice = random.Random(1)
    plain = [f"word{c}{d}" for c in "abcdefgh" for d in "xyzuvw"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = dice.choices(plain, k=80)
        for _ in range(4 if bad else 0):
            text[dice.randrange(80)] = "bozo" if dice.random() < 0.5 else "grunk" + dice.choice(["el", "ion", "ard", "is"])
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(900, "B0Z0 worda " * 6 + " ".join(plain), "s"), (901, "bоzo " * 5 + " ".join(plain), "s"), (902, None, "s"), (903, "", "s"), (None, "wordax", "s")]
    lexicon = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert " bozo " in lexicon.terms and any(t.startswith(" grun") for t in lexicon.terms)
    got = {r["doc_id"]: r for r in toxicity.scored(frame(spark, rows), lexicon).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    wrong = sum(got[i]["predicted"] != t for i, _, t in labels if got[i]["held_out"])
    assert wrong == 0 and got[900]["predicted"] == got[901]["predicted"] == 1 and got[902]["predicted"] == got[903]["predicted"] == 0
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    kept = toxicity.without_toxic(frame(spark, rows), lexicon)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())


def test_toxicity_exceptions_void_hits():
    found = toxicity.Lexicon({" trash ": 5.0}, [" trash can "]).automaton()
    assert toxicity.hits_of(found, toxicity.folded("Trash can, trash!")) == {10: 5.0}


def test_toxicity_hits_against_a_plain_scan():
    dice = random.Random(21)
    terms = {" bad ": 3.0, " bad": 1.0, " ugl": 2.0, " worse ": 4.0, " ba": 0.5}
    phrases = [" not bad ", " ugly duck ", " bad bad "]
    automaton = toxicity.Lexicon(terms, phrases).automaton()
    for _ in range(300):
        text = toxicity.folded(" ".join(dice.choices(["bad", "b4d", "badly", "ugly", "UGL1", "duck", "not", "worse", "bat", "x"], k=dice.randint(0, 12))))
        want = {}
        for at in range(len(text)):
            weights = [w for t, w in terms.items() if text[at : at + len(t)] == t]
            if weights and not any(text[lo : lo + len(p)] == p and lo <= at < lo + len(p) - 1 for p in phrases for lo in range(len(text))):
                want[at] = max(weights)
        assert toxicity.hits_of(automaton, text) == want


def test_toxicity_counts_against_a_plain_count():
    dice = random.Random(22)
    texts = [" ".join(dice.choices(["alpha", "alphabet", "beta", "be", "gamma", "gammas"], k=dice.randint(0, 15))) for _ in range(450)]
    labels = [dice.randint(0, 1) for _ in texts]
    got = collections.Counter()
    for part in toxicity._terms((4, 5))(iter([pd.DataFrame({"text": texts, "_toxic": labels})])):
        for r in part.itertuples():
            for name in ("toxic", "clean", "times_toxic", "times_clean", "twice_toxic", "twice_clean"):
                got[r.term, name] += getattr(r, name)
    want = collections.Counter()
    for text, toxic in zip(texts, labels, strict=True):
        side = "toxic" if toxic else "clean"
        own = collections.Counter(t for w in text.split() for t in [f" {w} ", *[f" {w[:n]}" for n in (4, 5) if len(w) > n]])
        want["", f"times_{side}"] += len(text.split())
        for term, n in own.items():
            want[term, side] += 1
            want[term, f"times_{side}"] += n
            want[term, f"twice_{side}"] += n > 1
    assert +got == +want


def test_stages_on_empty_tables(spark, docs):
    none, labels = docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(none, labels)
    assert toxicity.scored(none, lexicon).count() == 0 and toxicity.without_toxic(none, lexicon).columns == docs.columns
    for stage in (simhash.one_of_each, secrets.masked, mixing.mixed):
        assert stage(none).columns == docs.columns and stage(none).count() == 0


def test_toxicity_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, toxicity.fit(docs, empty)).filter("predicted = 1").count() == 0


@pytest.mark.parametrize("width,seed", [(35, 5), (9, 2)])
def test_substrings(spark, docs, width, seed):
    rows = [r["text"] for r in docs.select("text").collect()]
    seen = collections.Counter(tuple(w[i : i + width]) for w in map(words, rows) for i in range(len(w) - width + 1))
    want = []
    for w in map(words, rows):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substrings.removed(docs, width, seed).select("n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got) == sorted(want) and sum(x[1] for x in want) > 0


@pytest.mark.parametrize("scale", [64.0, 8.0])
def test_topk(spark, scale):
    dice = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in dice.normal(size=6).round(1)], 1) for i in range(150)]
    rows += [(200, rows[0][1], 1), (200, rows[1][1], 1), (201, None, 1), (220, [float("nan")] * 6, 1), (240, [None] * 6, 1), (None, rows[0][1], 1), (260, [1.0], 1), (280, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, scale=scale, block_rows=40, per_block=3, at_once=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ok = [(i, np.floor(scale * np.float32(v).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v is not None and not any(x is None or x != x for x in v)]
    for i, q in ok:
        if i % 20 == 0 and i != 200:
            want = sorted(((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q)))[:5]
            assert got[i] == [(j, -s) for s, j in want]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_urls(spark):
    entries = spark.createDataFrame(
        [("domain", "bad.org", "block", 100), ("domain", "bad.org", None, 200), ("host", "a.bad.org", "allow", 150), ("prefix", "x.com/ads", "block", 0), ("url", "x.com/ads/ok", "allow", 50), ("odd", "x.com", "block", 0), ("host", None, "block", 0), ("domain", "bad.org", "block", 90_000_000)],
        "kind string, key string, verdict string, at long",
    )
    captures = [(1, "http://BAD.org/", 99), (2, "http://bad.org:80/x?y#z", 100), (3, "https://u@a.bad.org./", 160), (4, "http://bad.org", 200), (5, "http://x.com/ads/1", 60), (6, "http://x.com/ads/ok", 49), (7, "http://x.com/ads/ok", 50), (8, None, 5), (9, "nonsense", 5), (10, "http://bad.org/", None), (11, "http://c.bad.org/q", 90_000_001), (1, "http://BAD.org/", 99)]
    got = urls.judged(spark.createDataFrame(captures, "capture long, url string, fetched long"), entries)
    want = {1: None, 2: "block", 3: "allow", 4: None, 5: "block", 6: "block", 7: "allow", 8: None, 9: None, 10: None, 11: "block"}
    assert got.count() == len(captures) and {r["capture"]: r["verdict"] for r in got.collect()} == want
    dealt = urls.judged(spark.createDataFrame(captures, "capture long, url string, fetched long"), entries, per_window=1)
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert urls.judged(spark.createDataFrame([], "capture long, url string, fetched long"), entries).count() == 0
    assert urls.judged(spark.createDataFrame(captures, "capture long, url string, fetched long"), entries.limit(0)).filter("verdict is not null").count() == 0


def test_mixing(spark, docs):
    got = mixing.mix_table(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_table(docs.repartition(7)).collect()), key=str)
    rows = corpus()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and level * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    target = {s: 2.0 * size[s] if s in capped else level * weight[s] for s in names}
    of = {(i, len(words(t))): s for i, t, s in rows}
    taken = collections.Counter()
    for r in got:
        s = of[(r["doc_id"], r["size"])]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 600 for s in names)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix_table(docs.limit(0)).count() == 0


def plain_spans(text):
    """The plain patterns of the contract, character by character, without regular expressions."""
    ascii_lower = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low, found = ascii_lower(text), []

    def run(at, chars):
        end = at
        while end < len(text) and text[end] in chars:
            end += 1
        return end

    def assigned(at):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, at):
                to = at + len(word)
                to += to < len(text) and text[to] in "\"'"
                to = run(to, " ")
                if to < len(text) and text[to] in ":=":
                    to = run(to + 1, " ")
                    to += to < len(text) and text[to] in "\"'"
                    return to, run(to, value)
        return None

    at = 0
    while at < len(text):
        hit = assigned(at)
        if hit and hit[1] > hit[0]:
            found += [(at, "assign", hit[1])] if hit[1] - hit[0] >= 6 else []
            at = hit[1]
        else:
            at += 1
    for kind, start, chars, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            end = run(at + len(start), chars) if text.startswith(start, at) else at
            if end > at + len(start):
                found += [(at, kind, end)] if end - at >= least else []
                at = end
            else:
                at += 1
    return sorted(found, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


def test_secrets(spark):
    token, dice = hashlib.sha256(b"1").hexdigest()[:22], random.Random(12)
    texts = ["é password = 'hunter22xx' and AKIA" + "ABCDEFGHIJ234567", f"key {token} end", "0123456789abcdef" * 2, "api_KEY:short token=abc", "a" * 22 + "1", None, "", "plain words only " * 300, "a" * 23 + "1"]
    bits = ["password", "PassWd", "token", "secret", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "=", ":=", "AKIA", "ABCDEFGHIJ234567", "x9/+.", "é", "0123abcdef", "deadbeef", "\n", "ſecret", "toKen=tokens=abcdefg"]
    texts += ["".join(dice.choices(bits, k=dice.randint(1, 14))) for _ in range(400)]
    texts += [f"noise line {i} with ordinary text" for i in range(50)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in secrets.report(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        base = [f"{k}:{a}:{b}" for a, k, b in plain_spans(t or "")]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("random")] == base
    assert (got[0]["n_assign"], got[0]["n_access"]) == (1, 1) and got[0]["spans"].startswith("assign:2:24")
    assert got[1]["spans"] == "random:4:26" and got[2]["n_hex"] == 1 and got[3]["n_assign"] == 0 and got[4]["spans"] == "" and got[5]["spans"] == "" and got[8]["spans"] == "hex:0:24"
    masked = {r["doc_id"]: r for r in secrets.masked(frame(spark, rows)).collect()}
    assert masked[1]["text"] == "key [secret] end" and masked[1]["n_chars"] == 16 and masked[5]["text"] is None and len(masked) == len(rows)
    assert secrets.masked(frame(spark, rows)).columns == frame(spark, rows).columns
    twice = secrets.report(frame(spark, [*rows, rows[1], rows[1], (None, texts[1], None), (None, None, None)])).collect()
    assert sum(r["spans"] == "random:4:26" for r in twice) == 4 and sum(r["doc_id"] is None for r in twice) == 2
    assert secrets.report(frame(spark, rows).limit(0)).count() == 0 and secrets.masked(frame(spark, rows).limit(0)).count() == 0


def test_simhash(spark, docs):
    def fingerprint(text):
        w = words((text or "").encode().lower().decode()) if text else []
        if not w:
            return 0
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = corpus()
    fps = [fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[top(j)] = top(i)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    want = sorted(((d, f"{fps[i]:016x}", least.get(top(i))) for i, (d, _, _) in enumerate(rows)), key=str)
    assert sorted(map(tuple, simhash.near_groups(docs).collect()), key=str) == want
    kept = simhash.representatives(docs, simhash.near_groups(docs))
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted({d for d, _, c in want if d is not None and d == c}) and ids.count(None) == 2
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_hamming_links_are_complete(spark):
    dice = random.Random(2)
    base = [dice.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << k for k in dice.sample(range(64), dice.randint(0, 4))) for b in base for _ in range(15)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_sharding(spark, docs):
    got = sharding.sharded(docs).collect()
    size, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"]].add(r["shard"])
    assert len(got) == len(corpus()) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) <= set(range(8))
    assert all(len(s) == 1 for s in where.values())  # equal texts share a shard
    want = [(len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for _, t, _ in corpus()]
    assert sorted(((r["size"], r["text_crc32"]) for r in got), key=str) == sorted(want, key=str)
    assert max(size.values()) <= sum(size.values()) / 8 + max(r["size"] for r in got)
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_best_fit_decreasing_is_the_textbook_one():
    dice = random.Random(4)

    def textbook(sizes, capacity, most):
        room, bins = [], collections.defaultdict(list)
        for n in sorted(sizes, reverse=True):
            fit = [(r, b) for b, r in enumerate(room) if r >= n]
            if fit:
                b = min(fit)[1]
            elif len(room) < most:
                b = len(room)
                room.append(capacity)
            else:
                b = -max((r, -b) for b, r in enumerate(room))[1]  # ties: the bin opened first
            room[b] -= n
            bins[b].append(n)
        return sorted(map(sorted, bins.values()))

    for case in range(60):
        count, most = (5000, 8) if case == 0 else (dice.randint(0, 60), dice.choice([3, 1000]))
        sizes = [dice.randint(1, 600 if case == 0 else 60) for _ in range(count)]
        capacity = -(-sum(sizes) // 8) if case == 0 else 100
        bins, seen = collections.defaultdict(list), collections.defaultdict(list)
        for n, first, end, b in sharding.best_fit_runs(list(collections.Counter(sizes).items()), capacity, most):
            bins[b] += [n] * (end - first)
            seen[n] += range(first, end)
        assert sorted(map(sorted, bins.values())) == textbook(sizes, capacity, most)
        assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(c)) for n, c in collections.Counter(sizes).items()}


def test_a_group_above_the_share_has_a_shard_of_its_own():
    plan = sharding.planned([(5000, 2), (10, 900), (3, 100)], 8)
    load = collections.Counter()
    for n, first, end, b in plan:
        load[b] += n * (end - first)
    assert sorted(load.values())[-2:] == [5000, 5000] and max(sorted(load.values())[:6]) - min(load.values()) <= 10 and sum(load.values()) == 19300
    assert sorted(r for n, a, b, _ in plan if n == 5000 for r in range(a, b)) == [0, 1] and sharding.planned([], 8) == []


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, cap = Tokenizer.from_file(path), 100
    want = collections.Counter()
    for d, text, _ in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, i in enumerate(range(0, len(ids), cap)):
            own = np.array(ids[i : i + cap], "<u4")
            want[(d, k, i, len(own), zlib.crc32(own.tobytes()))] += 1
    got = packing.packed(docs, path, cap).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= cap
    least = -(-sum(r["length"] for r in got) // cap)
    assert len(bins) <= least * 1.1 + 1
    assert packing.packed(docs.limit(0), path, cap).count() == 0


def item_by_item(sizes, capacity):
    """Bins of best-two-fit, one item at a time."""
    left, bins = sorted(sizes), collections.Counter()
    while left:
        own = []
        while fits := [n for n in left if n <= capacity - sum(own)]:
            own.append(fits[-1])
            left.remove(fits[-1])
        small = min(own)
        room = capacity - sum(own) + small
        pairs = [(left[i] + left[j], left[j]) for j in range(len(left)) for i in range(j) if left[i] + left[j] <= room]
        if room > small and pairs and max(pairs)[0] > small:
            total, large = max(pairs)
            own.remove(small)
            own += [large, total - large]
            left.remove(large)
            left.remove(total - large)
            left = sorted([*left, small])
        bins[tuple(sorted(own))] += 1
    return bins


def test_best_two_fit_is_the_item_by_item_one():
    dice = random.Random(9)
    for _ in range(60):
        sizes = [dice.randint(1, 40) for _ in range(dice.randint(1, 70))]
        plan = packing.best_two_fit(dict(collections.Counter(sizes)), 40)
        got = collections.Counter(tuple(sorted(collections.Counter(used).elements())) for used, times in plan for _ in range(times))
        assert got == item_by_item(sizes, 40)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), packing.ChunkEncoder(path)
    texts = ["Two  Words\n and MORE", "", None, "é x"]
    assert not e.by_chunk and packing.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")).by_chunk
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_chunks_give_the_tokenizers_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, e, dice = Tokenizer.from_file(path), packing.ChunkEncoder(path, most=200), random.Random(6)
    letters = "aAéÉçßẞİıſKΣσςǆﬁÀ'’.,;:!?… \n\t́̈x019²½_-<|>\x01\x85 漢😀ÅÅ"
    texts = ["".join(dice.choices(letters, k=dice.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|> a", "a.. b.) c. d,\ne.", "We'LL don't É."]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_vectors(spark):
    dice = np.random.default_rng(7)
    rows, n = [], 0
    for c in range(30):
        base = dice.normal(size=16)
        for _ in range(8):
            rows.append((n, [float(x) for x in base + dice.normal(scale=dice.choice([0.02, 0.12, 0.2]), size=16)], c % 2))
            n += 1
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 1), (502, rows[0][1], None), (503, None, 0), (504, [0.0] * 16, 0), (505, [float("inf")] * 16, 0), (506, [None] * 16, 0), (507, [1.0], 0), (508, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [(i, np.array(v) / np.linalg.norm(v), b) for i, v, b in rows if i is not None and b is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near, reach = collections.Counter(), {i: i for i, _, _ in rows if i is not None}
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and float(a[1] @ b[1]) >= 0.98]
    for _ in range(40):
        for a, b in pairs:
            reach[a] = reach[b] = min(reach[a], reach[b])
    for a, b in pairs:
        near[a] += 1
        near[b] += 1
    want = {i: (near[i], reach[i], reach[i] == i) for i in reach}
    for how in ({}, {"tile": 3, "sample": 50, "probes": 8}):
        got = {r["vec_id"]: tuple(r)[1:] for r in vectors.near_vectors(df, **how).collect()}
        assert got.pop(None) == (0, None, None) and got == want and len(pairs) > 50
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_recall_with_hundreds_of_lists(spark):
    """400 lists: at least nine of ten linked pairs of different vectors meet."""
    dice, rows = np.random.default_rng(17), []
    for _ in range(1600):
        base = dice.normal(size=32)
        for _ in range(4):
            rows.append((len(rows), [float(x) for x in base + dice.normal(scale=0.12, size=32)], 0))
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df, per_list=16).collect()}
    assert all(got[i] <= n for i, n in enumerate(want)) and want.sum() > 2000
    assert sum(got.values()) >= 0.9 * want.sum(), (sum(got.values()), want.sum())


def test_clashing_columns_of_vectors_and_urls(spark):
    """Further columns with names that the operators use inside change nothing."""
    dice = np.random.default_rng(3)
    rows = [(i, [float(x) for x in dice.normal(size=4).round(1)], i % 2) for i in range(60)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    more = plain
    for c in ("v", "q", "n", "k1", "cid", "list", "b", "block", "ids", "rank", "score", "query_id", "least", "kept"):
        more = more.withColumn(c, F.lit("x"))
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(topk.top_k(more, F.col("vec_id") % 20 == 0)) == order(topk.top_k(plain, F.col("vec_id") % 20 == 0))
    assert order(vectors.near_vectors(more)) == order(vectors.near_vectors(plain))
    captures = spark.createDataFrame([(1, "http://a.b/c", 5), (2, "http://a.b/d", 5)], "capture long, url string, fetched long")
    entries = spark.createDataFrame([("host", "a.b", "block", 1)], "kind string, key string, verdict string, at long")
    wide, odd = captures, entries
    for c in ("host", "rest", "u", "k", "span", "time", "point"):
        wide, odd = wide.withColumn(c, F.lit("x")), odd.withColumn(c, F.lit("x"))
    assert order(urls.judged(wide, odd)) == order(urls.judged(captures, entries))
