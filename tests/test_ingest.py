"""The quarantine: what is broken is kept with its reasons, what is good is not harmed."""

import json

from utxolens.sources import ingest as N

A = "a1" * 32


def lines(tmp_path, rows):
    path = tmp_path / "raw"
    path.mkdir()
    (path / "part.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def tx(**change):
    return {"txid": A, "fee": 5, "weight": 400, "vin": [{"txid": "b2" * 32, "vout": 0, "prevout": {"value": 9}}], "vout": [{"value": 4}]} | change


def test_transactions(spark, tmp_path):
    rows = [
        (tx(), []), (tx(txid=A.upper(), fee=None, vin=[{"prevout": None}]), []), (tx(vin=[], vout=[]), []), (tx(weight=None), []),
        (tx(txid="xyz"), ["TXID"]), (tx(txid=None, weight=0), ["TXID", "WEIGHT"]), (tx(vin=None), ["INPUTS"]), (tx(vout=[None]), ["OUTPUTS"]), (tx(vout=[{"value": -1}]), ["AMOUNT"]),
        (tx(vout=[{"value": 2_100_000_000_000_001}]), ["AMOUNT"]), (tx(vout=[{}]), ["AMOUNT"]), (tx(vin=[{"prevout": {"value": -4}}]), ["PREVOUT"]), (tx(fee=-1), ["FEE"]),
        ('{"txid": "' + A, ["MALFORMED"]), (tx(vout=[{"value": 1.5}]), ["MALFORMED"]), (tx(vout="none"), ["MALFORMED"]), ("[1]", ["MALFORMED"]),
    ]
    path = lines(tmp_path, [r for r, _ in rows])
    out = str(tmp_path / "out")
    N.write_judged(N.judged_transactions(N.read_lines(spark, path, N.TX)), out)
    good = N.read_judged(spark, out, N.TX, "good").collect()
    bad = N.read_judged(spark, out, N.TX, "rejected").collect()
    assert len(good) == sum(not w for _, w in rows)
    assert (good[0]["fee"], good[0]["vin"][0]["prevout"]["value"], good[0]["vout"][0]["value"]) == (5, 9, 4)
    assert sorted(r["reasons"] for r in bad) == sorted(w for _, w in rows if w)
    assert '{"txid": "' + A in {r["_corrupt_record"] for r in bad}


def test_outspends_and_summaries(spark, tmp_path):
    rows = [
        ({"txid": A, "outspends": [{"spent": False}, {"spent": True, "txid": A, "vin": 0}]}, []), ({"txid": A, "outspends": None}, ["SPENT"]), ({"txid": A, "outspends": [{"spent": None}]}, ["SPENT"]),
        ({"txid": A, "outspends": [{"spent": True, "txid": "q", "vin": -1}]}, ["SPENDER", "VIN"]), ({"txid": A, "outspends": [{"spent": "yes"}]}, ["MALFORMED"]),
    ]
    got = N.judged_outspends(N.read_lines(spark, lines(tmp_path, [r for r, _ in rows]), N.OUTSPENDS))
    assert [r["reasons"] for r in got.collect()] == [w for _, w in rows]
    raw = spark.createDataFrame([("a", (1, 1, 1, 0, None), (0, 0, 0, 0, 0), None), (None, None, (0, 0, 0, 0, -2), None)], N.SUMMARY)
    assert [r["reasons"] for r in N.judged_summaries(raw).collect()] == [[], ["ADDRESS", "CHAIN", "MEMPOOL"]]


def test_nothing_to_read(spark, tmp_path):
    out = str(tmp_path / "out")
    N.write_judged(N.judged_transactions(N.read_lines(spark, lines(tmp_path, []), N.TX)), out)
    assert N.read_judged(spark, out, N.TX, "good").count() == N.read_judged(spark, out, N.TX, "rejected").count() == 0
