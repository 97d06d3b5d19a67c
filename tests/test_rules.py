"""Small literal cases of routers, dimensions, case search, timeline filter, edits, syndicates, traces and untried mixes."""

from utxolens.operators import cases as C
from utxolens.operators import evidence as E
from utxolens.operators import graph as G
from utxolens.operators import transactions as X
from utxolens.operators import typologies as Y
from utxolens.sources import dims as D
from utxolens.streaming import alerts as A


def test_swap_routers(spark):
    rows = [(1, "x1FIXEDy", None), (2, "bc1qthor9", "sideshift ai router"), (3, None, "My Swap"), (4, "q", "plain"), (5, None, None)]
    got = {r["node"]: (r["router"], r["risk"]) for r in Y.swap_routers(spark.createDataFrame(rows, "node int, address string, name string"), D.ROUTERS, D.ROUTER_WORDS).collect()}
    assert got == {1: ("FixedFloat Instant Swap", "high"), 2: ("SideShift AI Router", "high"), 3: ("My Swap", "high")}


def test_dimension_hits(spark):
    a = spark.createDataFrame([("1fixed1",), ("1fixed2",), (None,), ("zz",)], "address string")
    got = {(r["kind"], r["key"]): r["hits"] for r in Y.dimension_hits(a, [r for r in D.rows() if r[0] in ("provider", "router")]).collect()}
    assert got == {("provider", "1Fixed"): 2, ("router", "1Fixed"): 2}
    assert D.frame(spark).count() == len({r[:2] for r in D.rows()})


def test_search_and_timeline_filter(spark):
    cases = spark.createDataFrame([("c1", "Ring", None, None), ("c2", "x", "y", "suspectRING"), ("c3", "x", "y", None)], "id string, title string, description string, suspect string")
    assert {r["id"] for r in C.search_cases(cases, "ring").collect()} == {"c1", "c2"} and C.search_cases(cases, "  ").count() == 3
    entries = spark.createDataFrame([("note", "About A", "B7"), ("note", None, None), ("flow", "a b7", None)], "kind string, summary string, reference string")
    assert C.filter_timeline(entries, " a B7").count() == 2 and C.filter_timeline(entries, "", "note").count() == 2 and C.filter_timeline(entries, "A b", "note").count() == 1


def test_action_edits(spark):
    rows = [(1, 1, {"evidence": "a"}), (1, 2, {"evidence": "a"}), (1, 3, {"state": "sent", "evidence": "b"}), (1, 4, {"nextFollowUpAt": "soon"}), (1, 5, {"evidence": "b", "nextFollowUpAt": "2024-02-01"}), (1, 6, {"nextFollowUpAt": ""}), (1, 7, {"nextFollowUpAt": ""}), (2, 1, {})]
    got = [tuple(r)[1:] for r in C.action_edits(spark.createDataFrame(rows, "action_id int, seq int, fields map<string,string>")).orderBy("action_id", "seq").collect()]
    assert got == [(1, "UPDATED", "evidence"), (2, "UNCHANGED", ""), (3, "UNSUPPORTED_FIELDS", None), (4, "INVALID_DATE", None), (5, "UPDATED", "evidence,nextFollowUpAt"), (6, "UPDATED", "nextFollowUpAt"), (7, "UNCHANGED", ""), (1, "UNCHANGED", "")]


def test_syndicates_of_three_kinds_of_link(spark):
    nodes = spark.createDataFrame([("A", "x"), ("B", "x"), ("B", "y"), ("C", "z"), ("D", "w"), ("E", "e"), ("F", "f"), ("G", None)], "case_id string, address string")
    inputs = spark.createDataFrame([(1, "y"), (1, "z"), (2, "e")], "txid long, address string")
    said = spark.createDataFrame([("D", "E")], "case_a string, case_b string")
    got = {r["case_id"]: r["syndicate"] for r in C.syndicates(nodes, inputs, said).collect()}
    assert got == {"A": "SYN-01", "B": "SYN-01", "C": "SYN-01", "D": "SYN-02", "E": "SYN-02"}
    assert C.syndicates(nodes.limit(0), inputs.limit(0), said.limit(0)).count() == 0


def test_trace_halts_at_mixes_and_follows_changes_further(spark):
    rows = [(i, i + 1, 10_000, i == 2) for i in range(8)] + [(1, 20, 10_000, False), (20, 21, 10_000, False), (0, 30, 500, True)]
    outputs = spark.createDataFrame(rows, "txid long, spend_txid long, value_sats long, peel boolean")
    roots, mixes = spark.createDataFrame([(0, 0)], "trace_id long, txid long"), spark.createDataFrame([(20,)], "txid long")
    got = {r["txid"]: r["depth"] for r in G.trace(outputs, roots, 3, mixes=mixes).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 20: 2, 3: 3, 4: 4}
    assert {r["txid"] for r in G.trace(outputs, roots, 3, mixes=spark.createDataFrame([(0,)], "txid long")).collect()} == {0}


def test_mixes_beyond_the_tried_ones(spark):
    candidates = spark.createDataFrame([(1, 1, -1), (1, 2, -1)], "txid long, mask int, change_vout long")
    mixes = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "txid long, equal_outputs long")
    got = {r["txid"]: (r["verdict"], r["confidence"]) for r in E.unmix_partitions(candidates, mixes, tried=spark.createDataFrame([(1,), (2,)], "txid long")).collect()}
    assert got == {1: ("unique", 92), 2: ("unsolved", 30), 3: ("untried", None)}


def test_newest_alerts_over_batches(spark, tmp_path):
    keep, path = A.keep_newest(str(tmp_path / "n"), 2), str(tmp_path / "n")
    for epoch, rows in enumerate([[("a", 1), ("b", 2)], [("c", 3)], [("d", 0)]]):
        keep(spark.createDataFrame([(a, f"t{n}", n) for a, n in rows], "address string, txid string, ts int"), epoch)
    assert {r["address"] for r in A.read_newest(spark, path).collect()} == {"b", "c"}
    assert sorted(p.name for p in (tmp_path / "n").iterdir()) == ["v1", "v2"]


def test_values_that_move_beside_a_null_are_changes(spark):
    rows = lambda *x: spark.createDataFrame(x, "k long, a long, b long")
    before = rows((1, None, 5), (2, None, None), (3, 1, 2), (None, 1, 1), (5, 1, 1))
    after = rows((1, 5, None), (2, None, None), (3, 1, None), (None, 1, 1), (6, 1, 1))
    got = {r["change"]: r["n"] for r in C.snapshot_diff(before, after, ["k"]).collect()}
    assert got == {"changed": 2, "unchanged": 2, "removed": 1, "added": 1}


def test_weight_zero_has_no_fee_rate(spark, tmp_path):
    tx = spark.createDataFrame([(1, 100, 0), (2, 100, 400)], "txid long, fee long, weight long")
    txi = spark.createDataFrame([(2, 1)], "txid long, sequence long")
    assert {r["txid"]: r["fee_rate_x10"] for r in X.tx_metrics(tx, txi).collect()} == {1: None, 2: 10}
    side = "array<struct<address:string,value_sats:long>>"
    feed = spark.sql(f"select 't' as txid, 5L as fee, 0L as weight, false as confirmed, timestamp'2024-01-01' as ts, cast(array(('a', 7L)) as {side}) as ins, cast(array() as {side}) as outs")
    watched = spark.createDataFrame([("A", "x")], "address string, tag string")
    assert [(r["amount_sats"], r["fee_rate"]) for r in A.alerts(feed, watched).collect()] == [(7, None)]
    none = A.read_newest(spark, str(tmp_path / "nothing"))
    assert none.collect() == [] and none.columns == A.alerts(feed, watched).columns


def test_pushed_data_of_any_length_is_no_opcode(spark):
    scripts = ["4d0300aabbcc87", "4e02000000aabb88", "4c02aabb75", "02aabbac", "4dff", ""]
    got = {r["opcode"]: r["n"] for r in E.opcodes(spark.createDataFrame([(s,) for s in scripts], "script string")).collect()}
    assert got == {77: 2, 135: 1, 78: 1, 136: 1, 76: 1, 117: 1, 2: 1, 172: 1}
