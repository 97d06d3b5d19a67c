"""Planted random tokens of every encoding, keys inside paths and compound names, and look-alikes that must stay."""

import math
import random
import time

import numpy as np
import pyarrow.parquet as pq

from utxolens.llm import secrets

LOWER, UPPER = "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIXED = UPPER + LOWER[10:]


def test_random_base36_fits(spark):
    dice = random.Random(36)
    for alphabet, sizes in ((LOWER, (16, 24, 40)), (UPPER, (24, 40)), (MIXED, (24, 40))):
        for n in sizes:
            drawn = ["".join(dice.choices(alphabet, k=n)) for _ in range(400)]
            fits = [secrets.encoding_of(t) and secrets.battery(t, secrets.encoding_of(t)) >= 0.001 for t in drawn]
            assert sum(map(bool, fits)) >= 0.98 * len(drawn), (alphabet[-1], n)


def test_planted_keys_are_found(spark):
    dice = random.Random(7)
    key = lambda alphabet, n: "".join(dice.choices(alphabet, k=n))
    planted = []
    for _ in range(40):
        planted += [("key ", key(LOWER, 32), " end"), ("key ", key(UPPER, 32), " end"), ("see https://host-a.example/my-files/item_list/", key(LOWER, 32), "/read-me-first"), ("get /api-v2/user_keys/", key(MIXED, 36), " now"), ("id live_test-", key(MIXED, 36), " ok")]
    plain = ["an ordinary line of text with some words in it " * 20, "see https://host-a.example/my-files/item_list/weekly-reports/read-me-first ok", "snake_case_name_of_variable and some-hyphenated-compound-word"] * 100
    docs = [(i, a + k + b) for i, (a, k, b) in enumerate(planted)] + [(1000 + i, t) for i, t in enumerate(plain)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.report(frame).collect()}
    masked = {r["doc_id"]: r["text"] for r in secrets.masked(frame).collect()}
    whole = [i for i, (a, k, b) in enumerate(planted) if f"random:{len(a)}:{len(a + k)}" in got[i]["spans"]]
    assert len(whole) >= 0.9 * len(planted)
    assert sum(k not in masked[i] for i, (_, k, _) in enumerate(planted)) >= 0.97 * len(planted)
    assert all(got[1000 + i]["spans"] == "" and masked[1000 + i] == t for i, t in enumerate(plain))


def test_recall_and_paths_on_given_texts(spark):
    """At least nine of ten planted tokens are found among ordinary documents, and no path, date or compound name is."""
    dice = random.Random(5)

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t][:600]
    plain = [
        "https://example.org/a/b/c/index2024html", "https://example.org/2024/05/some-long-article-name-7f3", "/usr/lib/python3.11/site-packages/numpy/core/multiarray.py",
        "HttpServletRequestWrapper2Impl", "order20240512item0042", "2024-05-12T10:33:21Z", "internationalization_of_names_v2", "AbstractSingletonProxyFactoryBean1", "articles2024index12",
    ]
    planted, rows = 0, []
    for i, text in enumerate(texts):
        words = text.split(" ")
        at = dice.randrange(len(words) + 1)
        if i % 3 == 0:
            alphabet = dice.choice([a for e, a in secrets.ALPHABETS.items()])
            n = dice.choice([20, 24, 32, 40, 64])
            token = "".join(dice.choices(alphabet, k=n))
            if alphabet == secrets.ALPHABETS["hex"]:
                token = token[:22].upper()
            planted += 1
        else:
            token = plain[i % len(plain)] if i % 3 == 1 else ""
        rows.append((i, " ".join([*words[:at], token, *words[at:]]), i % 3, token))
    before = {r["doc_id"]: r["n_random"] for r in secrets.report(spark.createDataFrame([(r[0], texts[r[0]]) for r in rows], "doc_id long, text string")).collect()}
    got = {r["doc_id"]: r["n_random"] for r in secrets.report(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    found = sum(got[i] > before[i] for i, _, k, _ in rows if k == 0)
    wrong = [t for i, _, k, t in rows if k and got[i] > before[i]]
    assert found >= 0.9 * planted and not wrong, (found, planted, wrong)


def test_the_battery_decides(spark, monkeypatch):
    """Tokens whose symbols are not uniform stay out, though no ordinary text would write them; without the battery they come in."""
    dice = random.Random(23)
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t][:400]
    rows = list("qwertyuiop asdfghjkl zxcvbnm".split())

    def crafted(i):
        kind = i % 4
        if kind == 0:  # a walk on the keyboard, a digit after each letter
            row = dice.choice(rows)
            return "".join(row[k % len(row)] + str((k + i) % 10) for k in range(13))
        if kind == 1:
            return "".join(dice.choice("Ab") + dice.choice("ab") for _ in range(13)) + str(i % 10) + "Q"
        if kind == 2:
            return "".join(f"{c}{c.lower()}{c}" for c in dice.choices("QXZJKVW", k=8)) + str(i % 10)
        return "".join(dice.choice(["get", "User", "Account", "Balance", "2nd", "Attempt", "Of", "Client"]) for _ in range(5)) + str(i)

    fixed = ["q1w2e3r4t5y6u7i8o9p0a1s2", "Abababababab1Abababababab1", "getUserAccountBalance2ndAttempt"]
    planted = {}
    for i in range(0, 400, 2):
        planted[i] = ("".join(dice.choices(MIXED, k=dice.choice([24, 32, 40]))), True) if i % 8 == 0 else (fixed[i // 2] if i < 6 else crafted(i // 2), False)
    docs = [(i, f"{t} {planted[i][0]} end" if i in planted else t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")

    def found():
        spans = {r["doc_id"]: r["spans"] for r in secrets.report(frame).collect()}
        return {i for i, (token, _) in planted.items() if f"random:{len(texts[i]) + 1}:{len(texts[i]) + 1 + len(token)}" in spans[i]}

    got, random_ones = found(), {i for i, (_, real) in planted.items() if real}
    assert len(got & random_ones) >= 0.9 * len(random_ones)
    assert not got & {i for i in range(0, 6) if i in planted and not planted[i][1]} and len(got - random_ones) <= 0.05 * len(planted)
    monkeypatch.setattr(secrets, "battery", lambda token, encoding: 1.0)
    without = found()
    assert len(without - got) > 0.3 * len(planted), (len(without), len(got))


def plain_added(texts, rate, level, step=0.1):
    """Added spans by loops over all tokens, families and limits: (text, start, end)."""
    tokens, totals, pairs = [], {}, np.zeros((67, 67))
    for d, text in enumerate(texts):
        base, own, others = secrets.tokens_of(text)
        hidden = [(a, b) for a, _, b in base] + [(t["s"], t["e"]) for t in own if t["fit"] >= 0.001]
        codes = [secrets._SYMBOL_OF[x] for x in text.encode()]
        ordinary = [not any(a <= i < b for a, b in hidden) for i in range(len(codes))]
        for i in range(len(codes) - 1):
            if ordinary[i] or ordinary[i + 1]:
                pairs[codes[i], codes[i + 1]] += 1
        for t in own:
            tokens.append((d, t))
        for n in others + [t["n"] for t in own]:
            totals[secrets._length_class(n)] = totals.get(secrets._length_class(n), 0) + 1
    model = secrets.text_model(pairs.astype(np.int64))
    out = []
    for d, t in tokens:
        family = [x for _, x in tokens if (x["encoding"], secrets._length_class(x["n"])) == (t["encoding"], secrets._length_class(t["n"]))]
        grid = lambda p: int(-math.log10(max(p, 1e-300)) / step)
        doubts = sorted((grid(x["fit"]) for x in family), reverse=True)
        cut = [b for k, b in enumerate(doubts) if 10 ** (-step * b) * len(doubts) <= level * sum(y >= b for y in doubts)]
        if cut and grid(t["fit"]) >= min(cut):
            continue
        bins = [int(model.evidence(x["token"], x["encoding"]) / step) for x in family]
        least = [b for b in range(max(bins) + 1) if sum(x >= b for x in bins) and 10 ** (-step * b) * totals[secrets._length_class(t["n"])] <= rate * sum(x >= b for x in bins)]
        mine = model.evidence(t["token"], t["encoding"])
        if least and mine >= step * min(least):
            out.append((-mine, t["s"] - t["e"], t["s"], d, t["e"]))
    taken = []
    for _, _, s, d, e in sorted(out):
        if all(d != x or e <= a or b <= s for x, a, b in taken):
            taken.append((d, s, e))
    return sorted(taken)


def test_added_spans_against_plain_loops(spark):
    dice = random.Random(31)
    words = "the path/to/some-file_name of HttpServerFactory2 and item2024order001 with /usr/lib/python3/site ".split()
    texts = []
    for i in range(60):
        own = dice.choices(words, k=dice.randint(5, 40))
        if i % 2:
            own.insert(dice.randrange(len(own)), "".join(dice.choices(dice.choice([LOWER, MIXED, MIXED + "+/", "0123456789ABCDEF"]), k=dice.choice([18, 28, 44]))))
        if i % 5 == 0:
            own.append("key_" + "".join(dice.choices(MIXED, k=30)) + "/" + "".join(dice.choices(LOWER, k=22)))
        texts.append(" ".join(own) + (" password=abc123456 AKIA" + "A" * 20 if i % 7 == 0 else ""))
    got = []
    for r in secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got += [(r["doc_id"], int(a), int(b)) for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x) if kind == "random"]
    want = plain_added(texts, 0.001, 0.02)
    assert sorted(got) == want and len(want) > 20


def test_ten_megabytes_take_seconds():
    dice = random.Random(2)
    part = " ".join(f"password={i}secretvalue {''.join(dice.choices(MIXED, k=24))} word{i} /a/b-{i}" for i in range(2000))
    text = part * (10_000_000 // len(part))
    began = time.process_time()
    base, tokens, _ = secrets.tokens_of(text)
    assert len(base) > 50_000 and len(tokens) > 50_000 and time.process_time() - began < 60
    limits = secrets.Limits(secrets.text_model(np.ones((67, 67), np.int64)), {(t["encoding"], secrets._length_class(t["n"])): 0.0 for t in tokens}, {})
    began = time.process_time()
    assert len(limits.chosen(tokens)) > 50_000 and time.process_time() - began < 30
