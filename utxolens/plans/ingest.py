"""Queries that write the ledger as a node's JSON answers, with faults that follow from the data, and read it back through the quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from utxolens.plans.evidence import folder
from utxolens.plans.registry import query
from utxolens.sources import ingest as N

MOST = 9_000_000


def written(v) -> str:
    """JSON lines, one a transaction: cut short where the key is divisible by 97, with a short txid at 89, without weight at 83, a weight of 0 at 79."""
    path, k = folder(v), F.col("txid")
    ins = v.txi.groupBy("txid").agg(F.collect_list(F.struct("vin", "prev_vout", "sequence", "value_sats")).alias("i"))
    outs = v.txo.groupBy("txid").agg(F.collect_list(F.struct("vout", "value_sats", "address")).alias("o"))
    rows = v.tx.join(outs, "txid", "left").join(ins, "txid", "left")
    name = F.sha2(k.cast("string"), 256)
    vin = F.transform(F.coalesce("i", F.array()), lambda x: F.struct(x["prev_vout"].alias("vout"), x["sequence"].alias("sequence"), F.struct(x["value_sats"].alias("value")).alias("prevout")))
    vout = F.transform("o", lambda x: F.struct(x["value_sats"].alias("value"), x["address"].alias("scriptpubkey_address")))
    weight = F.when(k % 79 == 0, 0).when(k % 83 != 0, F.col("weight"))
    line = F.to_json(F.struct(F.when(k % 89 == 0, F.substring(name, 1, 60)).otherwise(name).alias("txid"), "fee", weight.alias("weight"), vin.alias("vin"), vout.alias("vout")))
    rows.select(F.when(k % 97 == 0, F.substring(line, 1, 70)).otherwise(line).alias("value")).write.text(path)
    return path


@query("ingest_feed", "tx txo txi", f"""
, o as (select txid, count(*) as n, sum(value_sats) as s, max(value_sats) as m from txo group by txid), i as (select txid, max(value_sats) as m from txi group by txid),
j as (select n, s, case when t.txid % 97 = 0 then 'MALFORMED' else array_to_string(list_filter([case when t.txid % 89 = 0 then 'TXID' end, case when o.txid is null then 'OUTPUTS' end,
  case when i.m > {MOST} then 'PREVOUT' end, case when o.m > {MOST} then 'AMOUNT' end, case when t.txid % 79 = 0 then 'WEIGHT' end], lambda x: x is not null), ',') end as reasons
  from tx t left join o on o.txid = t.txid left join i on i.txid = t.txid)
select case when reasons = '' then 'good' else 'rejected' end as verdict, reasons, count(*) as records, coalesce(sum(n) filter (where reasons <> 'MALFORMED'), 0)::bigint as outputs,
  coalesce(sum(s) filter (where reasons <> 'MALFORMED'), 0)::bigint as sats from j group by all""")
def ingest_feed(v):
    path = folder(v)
    N.write_judged(N.judged_transactions(N.read_lines(v.spark, written(v), N.TX), MOST), path)
    good = N.read_judged(v.spark, path, N.TX, "good").select(F.lit("good").alias("verdict"), F.lit("").alias("reasons"), "vout")
    bad = N.read_judged(v.spark, path, N.TX, "rejected").select(F.lit("rejected").alias("verdict"), F.array_join("reasons", ",").alias("reasons"), "vout")
    held = good.unionByName(bad).withColumn("vout", F.when(F.col("reasons") != "MALFORMED", F.col("vout")))
    sats = F.aggregate("vout", F.lit(0).cast("long"), lambda a, x: a + x["value"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return held.groupBy("verdict", "reasons").agg(F.count("*").alias("records"), total(F.when(F.col("vout").isNotNull(), F.size("vout"))).alias("outputs"), total(sats).alias("sats"))
