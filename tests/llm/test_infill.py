"""Fill-in-middle by chunk summaries against regular expressions, with nulls, marks, long texts and a small memo."""

import hashlib
import random
import re

import pytest

from utxolens.llm import infill

LINES = re.compile("[^\n]*\n|[^\n]+")


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = LINES.findall(text)
    n = len(units)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(output), sha(text)


def texts():
    dice = random.Random(11)
    licence = "".join(f"licence line {i} of the terms\n" for i in range(80))
    out = [None, "", "\n", "\n\n\n", "one line", "one line\n", "a\n\nb", "ends in mark <S", "<P> inside", "x<M>y\nz", "é\n漢字\n🙂 end", "\r\nx\ry\n"]
    for _ in range(150):
        own = "".join(dice.choice(["ab ", "é", "漢", "\n", "word ", "\n\n", "<", "P>", "🙂"]) for _ in range(dice.randint(0, 400)))
        out.append(own + (licence if dice.random() < 0.3 else "") + own[::-1])
    return out + [licence * 60 + "tail", "no line feed " * 40_000, "\n" * 30_000, "z" * 50_000]


def test_whole_operator_against_regular_expressions(spark):
    rows = [(i, t, "x", "x") for i, t in enumerate(texts())] + [(None, "a\nb\nc", "x", "x"), (3, "another\nrow of id 3\n", "x", "x"), (3, "another\nrow of id 3\n", "x", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, form string")
    got = infill.transformed(docs)
    assert got.schema["prefix_chars"].nullable and got.columns[:7] == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = got.collect()
    assert sorted(map(repr, (tuple(r)[:7] for r in got))) == sorted(map(repr, (by_hand(*r[:2]) for r in rows)))
    assert all(hashlib.sha256(r["output"].encode()).hexdigest() == r["output_sha256"] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.transformed(docs.limit(0)).collect() == []
    rare = infill.transformed(docs, rate=20, texts=False).collect()
    assert all(r["output"] is None for r in rare) and 0 < sum(r["form"] != "plain" for r in rare) < 0.45 * len(rows)


@pytest.mark.parametrize("room", [0, 3000, 1 << 20])
def test_memo_changes_nothing_but_the_work(room):
    memo = infill.Memo(room)
    for doc_id, text in enumerate(texts() * 2):
        data = (text or "").encode()
        n, form, prefix, middle, output = infill.infilled(data, doc_id, memo)
        want = by_hand(doc_id, text)
        assert (n, form, prefix, middle, hashlib.sha256(output).hexdigest()) == want[1:6]
        assert infill.restored(output, form) == data
    assert memo.held == sum(len(c) for c, _ in memo.found.values()) and (memo.held <= room or len(memo.found) == 1)
    assert memo.hits > 0 or room == 0


def test_equal_hash_of_other_content_is_not_taken(monkeypatch):
    monkeypatch.setattr(infill.xxhash, "xxh3_64_intdigest", lambda data: 1)
    memo = infill.Memo()
    assert [memo.summary(c).chars for c in (b"ab\n", b"abcd", b"ab\n", b"ab\n")] == [3, 4, 3, 3] and memo.hits == 1


def test_chunks_are_cut_by_content():
    dice = random.Random(3)
    passage = bytes(dice.randrange(256) for _ in range(20_000))

    def cut(data):
        ends = infill.chunk_ends(data)
        return {data[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    one, two = cut(bytes(777) + passage), cut(b"other beginning" + passage + b"end")
    assert sum(map(len, one & two)) > 0.8 * len(passage)
    for segment in (64, 1000, 1 << 20):
        assert infill.chunk_ends(passage, segment=segment) == infill.chunk_ends(passage)
    ends = infill.chunk_ends(bytes(50_000))
    assert max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= 4096 and ends[-1] == 50_000 and infill.chunk_ends(b"") == []
