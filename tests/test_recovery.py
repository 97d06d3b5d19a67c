"""Recovery leads: repeats, taint, what is spent, missing evidence and follow-ups."""

import pytest

from utxolens.operators import recovery as R

NODES = """case_id string, node string, address string, kind string, balance_sats long, spent boolean, destination struct<type: string, source: string, verified: boolean>,
  attribution struct<confidence: double, source: string, verified: boolean>, contact struct<source: string, verified: boolean, verified_at: long>"""
LINKS = "case_id string, src string, dst string, value_sats long, txid long, edge_idx long, at long, height long"
ACTIONS = "case_id string, address string, state string, updated_at long, next_at long"
NOW = 1000 * R.DAY


def node(name, kind="receiver", balance=None, spent=None, held=None, told=None, contact=None, address=None):
    return ("k", name, address, kind, balance, spent, held, told, contact)


def leads(spark, nodes, links, actions=()):
    frames = (spark.createDataFrame(list(nodes), NODES), spark.createDataFrame([("k", *x) for x in links], LINKS), spark.createDataFrame([("k", "s")], "case_id string, node string"))
    found = R.recovery_leads(*frames, spark.createDataFrame([("k", *a) for a in actions], ACTIONS), NOW)
    return {r["address"]: r for r in found.collect()}


def test_repeats_and_clean_value(spark):
    links = [("s", "a", 600, 1, 1, NOW, 5), ("s", "a", 600, 1, 9, NOW, 5), ("c", "a", 400, 2, 2, NOW, 5), ("a", "x", 1000, 3, 1, NOW - 10 * R.DAY, 5), ("c", "y", 50, 4, 1, NOW, 5)]
    got = leads(spark, [node("s", "suspect"), node("c", "hop"), node("a", "hop"), node("x", balance=250, spent=False), node("y")], links)
    assert set(got) == {"x"}
    x = got["x"]
    assert (x["moved_sats"], x["sats"], x["available_sats"], x["recoverability"], x["freshness"], x["ambiguous"]) == (1000, 600, 250, "unspent_confirmed", "aging", False)
    assert x["rank"] == round(100 * ((80 / 90) * 0.2 + 0.4 * 0.45)) and (x["urgency"], x["destination"]) == ("not scheduled", "Unknown")


def test_spent_value_stays_only_with_a_verified_holder(spark):
    links = [("s", n, 100, i, i, None, None) for i, n in enumerate("abcd")]
    nodes = [node("s", "suspect"), node("a", spent=True), node("b", spent=True, held=("Exchange", "r", True)), node("c", spent=True, held=("Exchange", "r", False)), node("d", "op_return")]
    got = leads(spark, nodes, links)
    assert set(got) == {"b"}
    assert (got["b"]["recoverability"], got["b"]["available_sats"], got["b"]["destination"]) == ("spent_at_destination", 0, "Exchange")


def test_missing_times_and_confidence_count_nothing(spark):
    got = leads(spark, [node("s", "suspect"), node("a", told=(None, None, None), contact=(None, True, None)), node("b", kind=None, told=(7.0, None, None))], [("s", "a", 10**8, None, 1, None, None), ("s", "b", 10**8, 3, 2, None, 7)])
    assert (got["a"]["freshness"], got["a"]["last_at"], got["a"]["ambiguous"]) == ("unknown", None, True)
    value = 0.301029995 / 2 * 0.35
    assert got["a"]["rank"] == round(100 * value) and got["b"]["rank"] == round(100 * (value + (0.4 + 0.4 - 0.1) * 0.45))


def test_nodes_of_an_address_are_one_destination(spark):
    nodes = [node("s", "suspect"), node("a", address="A"), node("b", address="A", balance=5, spent=False)]
    got = leads(spark, nodes, [("s", "a", 70, 1, 1, NOW, 1), ("s", "b", 30, 1, 2, NOW, 1)])
    assert (got["A"]["sats"], got["A"]["senders"], got["A"]["recoverability"]) == (70, 1, "trace_boundary_unknown")


@pytest.mark.parametrize(("state", "updated", "due", "expected"), [
    ("submitted", NOW - 7 * R.DAY, None, "overdue"), ("submitted", NOW - 6 * R.DAY, None, "due soon"), ("awaiting_response", NOW, None, "scheduled"),
    ("planned", NOW, None, "not scheduled"), ("planned", None, NOW, "overdue"), ("completed", NOW, NOW, None),
])
def test_follow_ups(spark, state, updated, due, expected):
    rows = R.follow_ups(spark.createDataFrame([("k", "x", state, updated, due)], ACTIONS), NOW).collect()
    assert [r["urgency"] for r in rows] == ([expected] if expected else [])


def test_no_rows(spark):
    assert leads(spark, [], []) == {}
