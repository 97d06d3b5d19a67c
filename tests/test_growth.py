"""Work that must not grow faster than the input: views read once, no pairs made twice, results as before."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from utxolens import plans
from utxolens.operators import cases as C
from utxolens.operators import graph as G
from utxolens.operators import transactions as X
from utxolens.operators.iterate import components, settled
from utxolens.operators.joint import joint_cases
from utxolens.sources.views import Views

DATA = Path("/root/testdata/sf0.001")


def reads(df, table):
    """Whether the plan of df still reads a given table."""
    return any(f"{table}.parquet" in f for f in df.inputFiles())


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["aud_order_invariance", "gr_trace", "trace_stats", "gr_output_role", "jn_reuse_gate", "aud_heuristic"])
def test_outputs_are_computed_once(spark, name):
    assert not reads(plans.QUERIES[name](spark, str(DATA)), "lineitem")


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_one_pass_scores_both_orders(spark):
    v = Views(spark, str(DATA))
    back = v.txo.withColumn("vout", F.count("*").over(X.Window.partitionBy("txid")) - 1 - F.col("vout"))
    n = v.txo.groupBy("txid").agg(F.count("*").alias("n"))
    two = X.classify(v.tx, v.txi, back).join(n, "txid").select("txid", (F.col("n") - 1 - F.col("vout")).alias("vout"), "score_milli")
    one = X.turned(v.tx, v.txi, v.txo)
    assert sorted(map(tuple, one.select("txid", "vout", "flipped").collect())) == sorted(map(tuple, two.collect()))
    assert sorted(map(tuple, one.select("txid", "vout", "score_milli").collect())) == sorted(map(tuple, X.classify(v.tx, v.txi, v.txo).select("txid", "vout", "score_milli").collect()))


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["gr_recovery_leads", "agg_taint_ledger", "agg_edge_taint"])
def test_edges_are_computed_once(spark, name):
    assert not reads(plans.QUERIES[name](spark, str(DATA)), "lineitem")


def test_pairs_in_parts_equal_pairs_at_once(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(9), f"A{draw.randrange(6)}", draw.choice(("hop", "receiver")), draw.randrange(12)) for _ in range(60)] + [(3, None, "hop", 1)]
    nodes = spark.createDataFrame(rows, "case_id long, address string, type string, ord long")
    txi = spark.createDataFrame([(t, draw.choice((f"A{draw.randrange(8)}", None))) for t in range(12) for _ in range(4)], "txid long, address string")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(C.overlap(nodes, most=2), C.overlap(nodes))
    whole = {r["txid"]: (r["inputs"], r["matched"], r["cases"]) for r in C.joint_records(txi, nodes).collect()}
    assert same(C.joint_records(txi, nodes, most=1), C.joint_records(txi, nodes))
    held = {a: {c for c, b, _, _ in rows if b == a} for a in {r[1] for r in rows if r[1]}}
    spends = {t: {a for u, a in map(tuple, txi.collect()) if u == t and a} for t in range(12)}
    assert whole == {t: (len(s), len(s & held.keys()), len(set().union(*[held.get(a, set()) for a in s]))) for t, s in spends.items() if s}
    said = {(p, q, a) for p, a, _, x in rows for q, b, _, y in rows if a and a == b and p != q and ((x + y) % 3 == 0 or x % 2 == 0)}
    assert sorted(map(tuple, C.mutual_at(nodes).collect())) == sorted((p, q, a) for p, q, a in said if p < q and (q, p, a) in said)


def test_components_shrink_and_settle(spark):
    draw = random.Random(3)
    chain = [("p", f"{i:03d}", f"{i + 1:03d}") for i in range(200)]
    loose = [("q", f"{draw.randrange(300):03d}", f"{draw.randrange(300):03d}") for _ in range(180)]
    links = chain + loose
    low = {(g, x): x for g, *ends in links for x in ends}
    moved = True
    while moved:
        moved = False
        for g, a, b in links:
            least = min(low[g, a], low[g, b])
            moved = moved or low[g, a] != least or low[g, b] != least
            low[g, a] = low[g, b] = least
    linked = {(g, x) for g, a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, "g string, a string, b string"), ["g"], max_rounds=6)
    assert {(r["g"], r["node"]): r["component"] for r in found.collect()} == {k: v for k, v in low.items() if k in linked}


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_tasks_follow_the_input(spark, monkeypatch):
    twins = [plans.QUERIES[n](spark, str(DATA)).collect() for n in ("src_addr_history", "agg_is_mix")]
    monkeypatch.setattr("utxolens.sources.views.PART_BYTES", 8 << 10)
    v = Views(spark, str(DATA))
    assert v.parts > 10 and v.parts * (8 << 10) >= (DATA / "lineitem.parquet").stat().st_size
    for n, was in zip(("src_addr_history", "agg_is_mix"), twins, strict=True):
        now = plans.QUERIES[n](spark, str(DATA))
        assert n != "src_addr_history" or now.rdd.getNumPartitions() == v.parts
        assert sorted(map(tuple, now.collect())) == sorted(map(tuple, was))


def test_history_in_one_pass(spark):
    outs = [("a", 1, 5, 2, 7), ("a", 2, 7, None, None), ("a", 2, 7, 4, 7), ("a", 1, 5, 4, 7), (None, 3, 6, 9, None), (None, 3, None, None, None), ("b", 5, 7, None, None)]
    txo = spark.createDataFrame(outs, "address string, txid long, block_height long, spend_txid long, spend_height long")
    txi = txo.filter("spend_txid is not null").select("address", X.F.col("spend_txid").alias("txid"), X.F.col("spend_height").alias("block_height"))
    rows = lambda df: sorted(map(tuple, df.select("address", "txid", "block_height", "seq").collect()), key=str)
    assert rows(X.address_log(txo)) == rows(X.address_history(txo, txi)) and X.address_log(txo).count() == 7


def test_joint_cases_shuffle_no_pairs(spark):
    draw = random.Random(11)
    members = [(f"A{draw.randrange(12)}", draw.randrange(25)) for _ in range(90)] + [(None, 3), ("A1", None), ("Z", 4)]
    inputs = [(t, draw.choice((f"A{draw.randrange(14)}", None))) for t in range(30) for _ in range(5)]
    m = spark.createDataFrame(members, "address string, case_id long")
    i = spark.createDataFrame(inputs, "txid long, address string")
    want = sorted(map(tuple, C.joint_transactions(i.distinct().join(m.filter("case_id is not null").distinct(), "address")).collect()))
    for limits in ({}, {"work": 2000, "most": 20}, {"work": 1 << 40, "most": 9}):
        assert sorted(map(tuple, joint_cases(i, m, **limits).collect())) == want
    assert len(want) > 100 and joint_cases(i, m.limit(0)).count() == 0
    few = joint_cases(i, m, work=2000)
    assert "HashAggregate(keys=[case_a" not in few._jdf.queryExecution().toString() and few.rdd.getNumPartitions() > 4


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_edges_take_one_scan_of_the_lines(spark):
    assert Views(spark, str(DATA)).g2._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1


def test_only_edges_that_seeds_reach_are_kept(spark):
    rows = [(f"n{i}", f"n{i + 1}", 5) for i in range(9)] + [("n9", "n4", 1), ("x", "y", 3), ("y", "n2", 3), ("n3", "z", 0), ("s", "n0", 2), ("s", "n0", 2), ("end", "far", 7)]
    edges = spark.createDataFrame([("k", a, b, v, i) for i, (a, b, v) in enumerate(rows)], "case_id string, src string, dst string, value_sats long, edge_idx long")
    seeds = spark.createDataFrame([("k", "s"), ("k", "lone")], "case_id string, node string")
    for hops in (1, 3, 4, 20):
        got = sorted(r["edge_idx"] for r in G.reached_links(edges, seeds, hops).collect())
        assert got == [i for i, (a, b, v) in enumerate(rows) if v and a not in ("x", "y", "end")]
    assert {r["node"] for r in G.taint_poison(edges, seeds).collect()} == {"s", "lone", *(f"n{i}" for i in range(10))}


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_classification_shuffles_outputs_once(spark):
    v = Views(spark, str(DATA))
    v.outs = settled(v.outs)
    spent = v.outs.filter("spend_txid is not null").select(X.F.col("spend_txid").alias("txid"), "address", "script_type", X.F.struct("txid", "vout").alias("vin"))
    one = X.with_mix(X.classified(v.tx, spent, v.outs), "denom_sats")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 2  # outputs with inputs, and transactions
    assert sorted(r["txid"] for r in X.entropy(v.outs.withColumn("value_sats", F.col("denom_sats"))).filter("is_coinjoin").collect()) == sorted(r["txid"] for r in one.filter("mixed").select("txid").distinct().collect())
    plain = X.classified(v.tx, v.txi, v.outs.drop("seen"))
    columns = ["txid", "vout", "self", "seen", "majority", "n_in", "score_milli", "verdict"]
    assert sorted(map(tuple, one.select(columns).collect()), key=str) == sorted(map(tuple, plain.select(columns).collect()), key=str)


def test_light_trace_equals_the_ledgers(spark):
    draw = random.Random(7)
    outs = [(t, k, draw.choice((None, draw.randrange(40), draw.randrange(40))), draw.choice((100, 5000, None, 9000)), draw.random() < 0.3) for t in range(40) for k in range(3)]
    outputs = spark.createDataFrame(outs, "txid long, vout long, spend_txid long, value_sats long, peel boolean")
    roots = spark.createDataFrame([(100 + t, t) for t in range(30)] + [(3, 1), (3, 1), (3, 7)], "trace_id long, txid long")
    mixes = spark.createDataFrame([(5,), (9,)], "txid long")
    want = sorted(map(tuple, G._traced(outputs, roots, 2, None, mixes, None)[0].select("trace_id", "txid", "depth").collect()))
    assert sorted(map(tuple, G.trace(outputs, roots, 2, mixes=mixes).collect())) == want
    assert sorted(map(tuple, G.trace(outputs.withColumn("mixed", F.col("txid").isin(5, 9)), roots, 2).collect())) == want and len(want) > 100


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_significant_takes_one_pass_by_address(spark):
    plan = plans.QUERIES["topk_significant"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning(address") == 1
    v = Views(spark, str(DATA))
    want = X.address_volume(v.txo, v.txi).join(v.tx.select("txid", "block_height"), "txid").select("address", "txid", "volume_sats", "block_height")
    assert sorted(map(tuple, X.address_moves(v.txo).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_significant_stops_for_outputs_without_address(spark):
    rows = [(a, t, 60_000_000 if t == 3 else 1, t) for a in ("x", None) for t in range(1, 5)]
    got = {r["address"]: (r["txid"], r["scanned"], r["pages"]) for r in X.significant(spark.createDataFrame(rows, "address string, txid long, volume_sats long, block_height long"), page=2).collect()}
    assert got == {"x": (3, 2, 1), None: (3, 2, 1)}


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_joint_record_takes_one_pass_of_the_lines(spark):
    assert not reads(plans.QUERIES["jn_joint_record"](spark, str(DATA)), "lineitem")


@pytest.mark.parametrize("ids", [(1, 255, 256), (-1, 0, 1 << 40), (0, 65_535, 65_536), (7, None, 8)])
def test_joint_records_of_any_ids(spark, ids):
    members = spark.createDataFrame([(c, a) for c in ids for a in ("x", "y")] + [(ids[0], "z")], "case_id long, address string")
    inputs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (2, "w"), (3, "x"), (3, None), (4, "w"), (4, "v")], "txid long, address string")
    n = sum(i is not None for i in ids)
    want = [(1, 2, 2, n, "RECORDED"), (2, 2, 1, 1, "ONE_CASE"), (3, 1, 1, n, "TOO_FEW_INPUTS"), (4, 2, 0, 0, "NO_CASE")]
    assert sorted(map(tuple, C.joint_records(inputs, members).collect())) == want
    assert sorted(map(tuple, C.joint_records(inputs, members, most=1).collect())) == want
