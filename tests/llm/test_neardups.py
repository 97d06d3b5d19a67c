"""Near-duplicates of the pipeline: planted copies at known similarities, against brute force over all pairs."""

import itertools
import random

import corpus_pipeline
from utxolens.llm import simhash

DOC = "doc_id long, text string"


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}


def edited(text, count, name):
    """text with `count` words, six or more apart, replaced."""
    w = text.split()
    for i in range(count):
        w[8 + 6 * i] = f"{name}x{i}"
    return " ".join(w)


def rows():
    dice = random.Random(8)
    out = [(i, " ".join(f"w{dice.randrange(500)}" for _ in range(200))) for i in range(30)]
    for i in range(20):  # 1 to 5 edits: similarity 0.95 to 0.77
        out.append((100 + i, edited(out[i][1], i % 5 + 1, f"e{i}")))
    passage = " ".join(f"p{i}" for i in range(120))
    out += [(200 + i, f"{passage} " + " ".join(f"q{i}y{j}" for j in range(20 + i))) for i in range(12)]
    for i in range(40):  # a hot group, some of whose pairs are under 0.8
        out.append((300 + i, edited(out[29][1], i % 8, f"h{i}")))
    return out + [(400, "a b c"), (401, "A b  c"), (402, "a b d"), (403, None), (404, " "), (None, out[0][1]), (None, None), (405, out[1][1]), (405, out[1][1])]


def brute(docs, percent=80):
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    own = [sets(t) for _, t in docs]
    for i, j in itertools.combinations(range(len(docs)), 2):
        if own[i] == own[j] or 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
            root[top(j)] = top(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, least.get(top(i))) for i, (d, _) in enumerate(docs)]


def test_groups_against_all_pairs(spark):
    docs = rows()
    got = simhash.similar_groups(spark.createDataFrame(docs, DOC).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs), key=str)
    assert simhash.similar_groups(spark.createDataFrame([], DOC)).count() == 0


def test_similarity_of_exactly_four_fifths(spark):
    words = [f"w{i}" for i in range(49)]  # 45 shingles; five at the end replaced: 40 of 50 in common
    docs = [(1, " ".join(words)), (2, " ".join(words[:44] + ["a", "b", "c", "d", "e"])), (3, " ".join(words[:43] + ["f", "g", "h", "i", "j", "k"]))]
    assert {tuple(r) for r in simhash.similar_groups(spark.createDataFrame(docs, DOC)).collect()} == set(brute(docs)) and brute(docs)[1] == (2, 1)


def test_pipeline_stage_removes_near_copies(spark):
    docs = rows()
    kept = [r[0] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, DOC), "").select("doc_id").collect()]
    assert sorted(d for d in kept if d is not None) == sorted({d for d, c in brute(docs) if d is not None and d == c}) and kept.count(None) == 2
    assert not {100 + i for i in range(20) if i % 5 < 4} & set(kept)  # copies at 0.95, 0.90, 0.86 and 0.81 are gone


def test_unrelated_texts_of_one_doc_id_stay(spark):
    word = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, word("a"), "x"), (1, word("b"), "y"), (2, word("a"), "x"), (3, word("b"), "x"), (3, word("b"), "x"), (4, word("c"), "x"), (4, word("c"), "x"), (None, word("a"), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [rows[0], rows[1], rows[5], rows[7]]))

def test_a_pair_meets_under_one_key_in_either_order(spark):
    dice, w = random.Random(4), 12
    rows = []
    for _ in range(300):
        seg = dice.getrandbits(w)
        edges = [sum(1 << b for b in dice.sample(range(w), 5)) for _ in range(2)]
        rows.append(([seg], [edges[0]], [seg ^ sum(1 << b for b in dice.sample(range(w), dice.randrange(3)))], [edges[1]]))
    keys = spark.range(1 << w).withColumnRenamed("id", "key")
    pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, pseg array<int>, pedge array<int>, qseg array<int>, qedge array<int>")
    side = lambda a, b: [simhash.F.lit(1 + (a == "q")).alias("a"), simhash.F.lit(1 + (b == "q")).alias("b"), *[simhash.F.col(x + c).alias(y + c) for x, y in ((a, "a"), (b, "b")) for c in ("seg", "edge")]]
    met = [sorted(map(tuple, pairs.select("i", *side(*o)).crossJoin(keys).filter(simhash._meet_first(simhash.F.col("key"), w)).select("i", "key").collect())) for o in ("pq", "qp")]
    assert met[0] == met[1] and len({i for i, _ in met[0]}) == len(met[0]) > 50


def test_buckets_of_one_component_are_not_listed(spark, monkeypatch):
    text, counts, staged = rows()[29][1], {}, simhash.staged

    def counted(df, name):
        out = staged(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "staged", counted)
    docs = [(i, edited(text, 1, f"c{i}")) for i in range(60)]
    assert {r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(docs, DOC)).collect()} == {0}
    assert sum(counts["buckets"]) < 60 * 48  # each node has 96 keys; 5276 of 5760 rows before


def test_keys_are_summed_in_small_tasks_without_sorting(spark, monkeypatch):
    plans, staged = {}, simhash.staged

    def noted(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(simhash, "staged", noted)
    docs = rows()
    got = simhash.similar_groups(spark.createDataFrame(docs, DOC))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs), key=str)
    assert len(plans["buckets"]) == 1 and "SortAggregate" not in plans["buckets"][0]  # six tasks of 3.4 million keys each were sorted at 0.5 GB
    assert simhash._dealt(spark.range(20_000)).rdd.getNumPartitions() == 5 and simhash._dealt(spark.range(0)).count() == 0
