"""Small literal cases of the text functions, typologies, case jobs, imports and the alert stream."""

import datetime as dt

from pyspark.sql import functions as F

from utxolens.functions import memos as M
from utxolens.functions import scripts as S
from utxolens.functions import texts as T
from utxolens.operators import cases as C
from utxolens.operators import evidence as E
from utxolens.operators import transactions as X
from utxolens.operators import typologies as Y
from utxolens.sources import imports as I
from utxolens.streaming import alerts as A


def column(spark, values, name="a"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_address_types(spark):
    good = "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"
    cases = {good: "segwit", good[:-1] + "5": "invalid: checksum", good.upper(): "segwit", good[:-1] + "T": "invalid: mixed case", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT": "legacy", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy": "script", "1short": "invalid: characters or length", "": "invalid: empty", "xyz": "invalid: unknown", "bc1p5cyxnuxmeuwuvkwfem96lqzszd02n6xdcjrs20cac6yqjjwudpxqkedrcr": "taproot"}
    got = {r["a"]: r["type"] for r in T.with_address_type(column(spark, [*cases, None]), "a").collect()}
    assert got.pop(None) == "invalid: empty" and got == cases


def test_memos(spark):
    evm = "0x" + "ab" * 20
    cases = {"=:ETH.USDT:" + evm: ("THORChain", "ETH", "USDT", evm), "SSH:usdt:" + evm: ("SideShift", "ETH", "USDT", evm), "RETURN bridge:sol:me:usdc": ("Bridge", "SOL", "USDC", "me"), "pay " + evm: ("EVM", "ETH", "ERC-20", evm), "m:BTC.BTC:x": ("Maya", "BTC", "BTC", "x"), "hello": None, "": None, "6a0b" + b"=:BTC.BTC:y".hex(): ("THORChain", "BTC", "BTC", "y"),
        "0x" + b"SWAP:xmr:abc".hex(): ("Bridge", "XMR", "NATIVE", "abc"), "6a4c0f" + b"SSH:Taddr:usdt!".hex(): ("SideShift", "UNKNOWN", "USDT", "Taddr"), "to T" + "z" * 33 + " now": ("TRON", "TRX", "TRC-20", "T" + "z" * 33), "T" + "z" * 34: None,
        "solana: " + "A" * 40: ("Solana", "SOL", "SPL", "A" * 40), "B" * 40 + " on Sol " + "C" * 32: ("Solana", "SOL", "SPL", "C" * 32), "D" * 40: None, "1x sol " + "E" * 40: None, "BRIDGE:" + evm: ("Bridge", "ETH", "NATIVE", evm), "SWAP:ETH": None, "s:a.b": None}
    got = {r["a"]: tuple(r)[1:] if r["protocol"] else None for r in M.with_memo(column(spark, [*cases, None]), "a").collect()}
    assert got.pop(None) is None and got == cases


def test_layer_two_by_opcodes(spark):
    key, digest = "21" + "02" * 33, "20" + "a9" * 16 + "b1" * 8 + "63" * 8
    cases = {"52" + key + key + "52ae": "channel funding", "52" + key + "52ae": "none", "a8" + digest + "876321" + "03" * 33 + "6703000001b17568ac": "swap service",
        "63a8" + digest + "8867029000b27568ac": "hash-locked swap", digest + "ac": "none", "4d2000" + "a9b16367" * 8 + "87": "none", "": "none"}
    got = {r["a"]: r["l"] for r in column(spark, [*cases, None]).withColumn("l", S.layer_two(F.col("a"))).collect()}
    assert got.pop(None) == "none" and got == cases


def test_bridge_entities(spark):
    rows = [(1, "bc1qTHORx", None), (2, "a", "My SideShift desk"), (3, "b", "chain-hop desk"), (4, "crosschain1", ""), (5, "c", "plain"), (6, None, None)]
    providers = (("sideshift", "3Side", "SideShift AI Router", "high"), ("thorchain", "bc1qthor", "Vault", "critical"))
    got = {r["node"]: (r["id"], r["provider"], r["risk"]) for r in Y.bridge_entities(spark.createDataFrame(rows, "node int, address string, name string"), providers, ("chain-hop",), ("crosschain",)).collect()}
    assert got == {1: ("thorchain", "Vault", "critical"), 2: ("sideshift", "SideShift AI Router", "high"), 3: ("generic-bridge", "chain-hop desk", "high"), 4: ("generic-bridge", "Unattributed bridge", "high")}


def test_networks(spark):
    cases = {"0x" + "1" * 40: "EVM", "T" + "a" * 33: "TRON", "1abc": "BTC", "So11111111111111111111111111111111111111112": "SOL", "z" * 44: "none", "?": "none"}
    assert {r["a"]: r["n"] for r in column(spark, cases).withColumn("n", T.network_of(F.col("a"))).collect()} == cases


def test_carried_text_and_templates(spark):
    assert column(spark, ["6a" + b"hello".hex(), "6a05" + b"hello".hex(), "0014" + "a" * 40]).select(T.carried_text(F.col("a"))).collect()[0][0] == "hello"
    assert column(spark, ["5120" + "a" * 64]).select(T.template(F.col("a"))).first()[0] == "taproot"


def test_opcodes_pass_over_pushes(spark):
    got = {r["opcode"]: r["n"] for r in E.opcodes(spark.createDataFrame([("76a90201ff88ac",), ("4c02aabb51",), ("",)], "script string")).collect()}
    assert got == {0x76: 1, 0xA9: 1, 2: 1, 0x88: 1, 0xAC: 1, 76: 1, 0x51: 1}


def test_bands(spark):
    rows = [("s", v) for v in (1_000_000, 1_010_000, 1_020_000, 9_000_000, 100)] + [("t", 5_000_000)] * 2
    got = Y.value_bands(spark.createDataFrame(rows, "src string, value_sats long"), ["src"]).collect()
    assert [(r["src"], r["bands"], r["largest"], r["mean_sats"]) for r in got] == [("s", 1, 3, 1_010_000)]


def test_mixes_by_share(spark):
    equal = [(1, i, 10_000_000) for i in range(6)] + [(2, i, 1000 + i) for i in range(144)] + [(2, 200 + i, 77_000) for i in range(3)]
    got = {r["txid"]: r["is_coinjoin"] for r in X.entropy(spark.createDataFrame(equal, "txid long, vout long, value_sats long")).collect()}
    assert got == {1: True, 2: False}


def test_custody_edit_is_found(spark):
    chain = C.custody_chain(spark.createDataFrame([("k", i, f"p{i}") for i in range(5)], "case_id string, seq long, payload string"))
    assert C.verify_custody(chain).first()["first_break"] is None
    bad = chain.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload")))
    assert C.verify_custody(bad).first()["first_break"] == 3


def test_endpoint_share_scores_more(spark):
    rows = [("a", 1, "x", "hop", 1), ("a", 2, "y", "receiver", 1), ("b", 1, "x", "hop", 1), ("b", 2, "y", "hop", 1), ("c", 1, "x", "hop", 1)]
    got = {(r["case_a"], r["case_b"]): (r["score"], r["verdict"]) for r in C.overlap(spark.createDataFrame(rows, "case_id string, ord long, address string, type string, value_sats long")).collect()}
    assert got[("a", "b")] == (55, "SAME_OPERATOR_LIKELY") and got[("b", "c")] == (20, "WEAK_OVERLAP")


def test_no_signal_no_risk(spark):
    n = spark.createDataFrame([("a", 1, "x", "suspect", 1), ("b", 1, "y", "mixer", 1)], "case_id string, ord long, address string, type string, value_sats long")
    got = {r["case_id"]: r["risk"] for r in C.risk(n, spark.createDataFrame([], "case_id string, node string, confidence long")).collect()}
    assert got == {"a": None, "b": 55}


def test_csv_guard_and_address_list(spark, tmp_path):
    I.write_csv(column(spark, ["=1+1", 'a"b', None]), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '"\'=1+1"' in text and '"a""b"' in text
    (tmp_path / "list.txt").write_text("﻿address,tag\nA1;x\n\"a1\"\ty\n\nA2\n")
    got = [(r["address"], r["tag"], r["duplicate"]) for r in I.read_address_list(spark, str(tmp_path / "list.txt")).orderBy("n").collect()]
    assert got == [("A1", "x", False), ("a1", "y", True), ("A2", "imported", False)]


def test_cases_last_of_an_id_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x", "v": 1}, {"id": null, "v": 2}, {"id": "x", "v": 3}]')
    assert [tuple(r) for r in I.read_cases(spark, str(tmp_path), "id string, v int").collect()] == [("x", 3)]


def test_stream_equals_its_batch_twin(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    tx = lambda i, a, b, v, ok=False: (i, 300, 800, ok, at + dt.timedelta(seconds=len(i)), [(a, v)], [(b, v)])
    rows = [tx("t1", "A", "b", 5), tx("T1", "A", "b", 5), tx("t2", "a", "A", 7), tx("t3", "z", "y", 1), tx("t4", "A", "b", 5, True), (None, 1, 4, False, at, [], [])]
    df, watched = spark.createDataFrame(rows, A.FEED), spark.createDataFrame([("a", "tag")], "address string, tag string")
    df.write.parquet(str(tmp_path / "in"))
    stream = A.alerts(spark.readStream.schema(A.FEED).parquet(str(tmp_path / "in")), watched)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    key = lambda d: sorted((r["address"].lower(), r["txid"].lower(), r["amount_sats"]) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(A.alerts(df, watched)) == [("a", "t1", 5), ("a", "t2", 7)]
    assert A.poll(df, watched).first()["state"] == "activity" and A.newest(A.alerts(df, watched), 1).count() == 1


def test_streamed_folds_keep_keys_apart(spark):
    rows = [("a", i, "p" if i % 3 else None) for i in range(20_000)] + [("b", 0, "p"), (None, 0, "q")]
    chain = C.custody_chain(spark.createDataFrame(rows, "case_id string, seq long, payload string"))
    got = {r["case_id"]: (r["events"], r["first_break"]) for r in C.verify_custody(chain).collect()}
    assert got == {"a": (20_000, None), "b": (1, None), None: (1, None)}
    assert C.custody_chain(chain.limit(0)).count() == 0


def test_bands_of_an_open_mean(spark):
    rows = [("s", 1_000_000 + 9_000 * i, False) for i in range(12)] + [("e", 2_000_000, True)] * 4 + [("n", None, False), ("n", 600, None)]
    got = Y.value_bands(spark.createDataFrame(rows, "src string, value_sats long, many_inputs boolean"), ["src"]).collect()
    assert [(r["src"], r["bands"], r["largest"]) for r in got] == [("s", 1, 11)]  # the twelfth is 54,000 over a mean of 1,045,000


def test_peels_over_the_last_hop_are_passed_over(spark):
    rows = [("x", 1, 1, [100_000, 900_000]), ("x", 2, 2, [200_000, 1_800_000]), ("x", 3, 3, [80_000, 800_000]), ("y", 1, 4, [100_000, 900_000])]
    got = Y.peel_chains(spark.createDataFrame(rows, "entity string, ord long, txid long, values array<long>")).collect()
    assert [(r["entity"], r["hops"], r["mean_tenths"], r["confidence"]) for r in got] == [("x", 2, 95, 76)]


def test_risk_signals(spark):
    rows = [(c, i, f"{c}{i}", t, 1) for c, ts in {"e": "hop mixer", "s": "hop", "m": "mixer", "r": "suspect", "x": "suspect", "z": "hop hop hop mixer"}.items() for i, t in enumerate(ts.split())]
    n = spark.createDataFrame(rows, "case_id string, ord long, address string, type string, value_sats long")
    told = [("e", True, True, True, False, None), ("s", None, None, None, None, "SIMULATED_ESTIMATE"), ("m", False, False, False, False, "MANUAL_HYPOTHESIS"), ("r", False, True, False, False, None), ("z", False, False, True, True, None)]
    signals = spark.createDataFrame(told, "case_id string, era boolean, rbf boolean, sanctioned boolean, darknet boolean, trace_type string")
    sweeps = spark.createDataFrame([("z", "q", 88), ("e", "q", 88)], "case_id string, node string, confidence long")
    scored = C.risk(n, sweeps, signals)
    got = {r["case_id"]: (r["status"], r["risk"]) for r in scored.collect()}
    assert got == {"e": ("ASSESSED", 12), "s": ("SIMULATED", None), "m": ("USER_SUPPLIED", None), "r": ("ASSESSED", 26), "x": ("INSUFFICIENT_EVIDENCE", None), "z": ("ASSESSED", 99)}
    urgency = {r["case_id"]: (r["urgency"], r["recommendations"]) for r in C.risk_actions(scored).collect()}
    assert urgency["e"][0] == "INFORMATIONAL" and urgency["s"][0] == "NOT_ASSESSED" and urgency["r"][0] == "ROUTINE"
    assert urgency["z"] == ("PRIORITY_ANALYST_REVIEW", "VERIFY_TRACE,INFER_NO_OWNERSHIP,CONSULT_COUNSEL,REVIEW_SWEEP,REVIEW_SANCTIONS_SOURCE")
    shown = [(r["place"], r["category"], r["points"]) for r in C.risk_signatures(scored).filter("case_id = 'z'").orderBy("place").collect()]
    assert shown == [(1, "Mixing check", 35), (2, "Split analysis", 36), (3, "Destination check", 0), (4, "Sweep check", 15), (5, "Attribution check", 15)]


def test_joint_transactions_of_few_and_many_addresses(spark):
    few = [(1, "x", "a"), (1, "y", "b"), (1, "x", "c"), (1, "y", "c"), (2, "x", "a"), (2, "x", "b"), (2, None, "b")]
    many = [(3, f"n{i:03}", "a" if i < 70 else "b") for i in range(80)] + [(3, f"n{i:03}", "c") for i in range(80)] + [(3, "n000", "b")]
    got = {(r["case_a"], r["case_b"]): r["joint_txs"] for r in C.joint_transactions(spark.createDataFrame(few + many, "txid long, address string, case_id string")).collect()}
    assert got == {("a", "b"): 2}


def test_ground_truth_counts(spark):
    expected = [("k", 1, 0, "bc1A", 5, "payment", "payee"), ("k", 1, 1, "x", None, "change", "change"), ("k", 2, 0, "y", 7, "payment", "end_receiver"), ("k", 2, 1, "z", 7, "payment", "intermediate"), ("q", 9, 0, "w", 1, "change", "change")]
    predicted = [("k", 1, 0, "BC1a", 5, None, 2, True, False), ("k", 1, 1, "x", 3, None, 1, True, True), ("k", 2, 0, "y", 7, "change", None, False, False), ("k", 2, 1, "z", 8, "receiver", None, True, True), ("k", 5, 0, "v", 1, None, None, None, None)]
    e = spark.createDataFrame(expected, "case_id string, txid long, vout long, address string, value_sats long, role string, node_role string")
    p = spark.createDataFrame(predicted, "case_id string, txid long, vout long, address string, value_sats long, kind string, score int, spent boolean, followed boolean")
    got = {r["case_id"]: r for r in C.ground_truth(e, p).collect()}
    names = ("expected", "predicted", "matched", "classified", "right_class", "right_role", "known_role", "precision_ppm", "recall_ppm", "f1_ppm", "class_ppm", "role_ppm", "coverage_ppm")
    assert [got["k"][n] for n in names] == [4, 5, 3, 2, 1, 2, 2, 600_000, 750_000, 666_666, 500_000, 500_000, 500_000]
    assert [got["q"][n] for n in names] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, None, 0, 0] and got[None]["expected"] == 5
    assert C.ground_truth(e.limit(0), p.limit(0)).count() == 0
