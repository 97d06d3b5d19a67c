"""Queries over single transactions, outputs and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from utxolens.functions import ledger as L
from utxolens.operators import transactions as X
from utxolens.plans.registry import query

NOW = 1_009_843_200  # 2002-01-01
_SUM = """select address, count(*) as funded_txo_count, sum(value_sats)::bigint as funded_txo_sum, count(spend_txid) as spent_txo_count,
  coalesce(sum(value_sats) filter (where spend_txid is not null), 0)::bigint as spent_txo_sum, count(distinct txid) as tx_count from txo group by address"""
_SEEN = """select txid, vout from (select *, min(struct_pack(h := block_height, t := txid)) over (partition by address) as f from txo)
  where f < struct_pack(h := block_height, t := txid)"""
_ID = "case when script_type = 'p2pk' then 'pubkey:' || substr(sha256(address), 1, 40) else address end"
_SELF = f"""select o.txid, o.vout from (select *, {_ID} as i from txo) o join (select distinct txid, {_ID} as i from txi) k on k.txid = o.txid and k.i = o.i"""
_MAJ = """select txid, arg_max(script_type, struct_pack(n := n, f := -f)) as majority from
  (select txid, script_type, count(*) as n, min(vin) as f from txi group by txid, script_type) group by txid"""
_CUSTODY = """case when address is null then 0 else least(95, case when script_type = 'p2sh' or starts_with(address, '3') then 35 else 0 end
  + case when script_type = 'v1_p2tr' or starts_with(address, 'bc1p') then 40 else 0 end + case when starts_with(address, 'bc1q') and length(address) = 62 then 15 else 0 end
  + case when {unspent} then 15 else 0 end) end"""
_ENTROPY = """select txid, outputs, round(h * 1000)::bigint as entropy_milli, round(h / log2(outputs) * 1000)::bigint as anonymity_milli, n as equal_outputs, v as modal_sats,
  (n >= 3 and n / outputs >= 0.2::double) or (n >= 2 and n / outputs >= 0.1::double and v in (500000, 1000000, 5000000, 10000000, 50000000)) as is_coinjoin from (
  select txid, sum(n)::bigint as outputs, -sum(n * (v / t) * log2(v / t)) as h, max(n) as n, -max(struct_pack(n := n, m := -v)).m as v from (
    select *, sum(n * v) over (partition by txid) as t from (select txid, value_sats as v, count(*) as n from {t} where value_sats > 0 group by all)) group by txid) where outputs > 1"""
_DENOM = "select txid, vout, address, script_type, denom_sats as value_sats, block_height, spend_txid, spend_height from txo"


def denom(v):
    return v.txo.withColumn("value_sats", F.col("denom_sats"))


def with_height(v):
    return v.txi.join(v.tx.select("txid", "block_height"), "txid")


@query("src_tx", "tx", "select txid, fee, weight, block_height, block_time from tx")
def src_tx(v):
    return v.tx.select("txid", "fee", "weight", "block_height", "block_time")


@query("src_outspends", "txo txi", "select o.txid, o.vout, i.txid is not null as spent, i.txid as spend_txid, i.vin as spend_vin from txo o left join txi i on i.prev_txid = o.txid and i.prev_vout = o.vout")
def src_outspends(v):
    i = v.txi.select(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout"), F.col("txid").alias("spend_txid"), F.col("vin").alias("spend_vin"))
    return v.txo.select("txid", "vout").join(i, ["txid", "vout"], "left").select("txid", "vout", F.col("spend_txid").isNotNull().alias("spent"), "spend_txid", "spend_vin")


@query("src_addr_history", "txo txi tx", """
select address, txid, block_height, row_number() over (partition by address order by block_height desc, txid desc) as seq
from (select address, txid, block_height from txo union select i.address, i.txid, t.block_height from txi i join tx t on t.txid = i.txid)""")
def src_addr_history(v):
    return X.address_log(v.txo)


@query("src_addr_summary", "txo", _SUM)
def src_addr_summary(v):
    return X.address_summary(v.txo)


@query("endpoint_profiles", "txo", f"""
select *, greatest(funded_txo_sum - spent_txo_sum, 0) as balance_sats, funded_txo_count >= 5 as is_aggregator,
  case when funded_txo_count = 0 then 'UNPROFILED' when funded_txo_sum - spent_txo_sum <= 0 and spent_txo_count > 0 then 'DRAINED_PASS_THROUGH'
       when funded_txo_count = 1 and spent_txo_count = 0 then 'SINGLE_USE_DEPOSIT' when funded_txo_count > 1 and spent_txo_count > 0 then 'ACTIVE_REUSED_WALLET'
       else 'DORMANT_HOLDER' end as profile from ({_SUM})""")
def endpoint_profiles(v):
    return X.endpoint_profiles(X.address_summary(v.txo))


@query("ingest_quarantine", "txo", """
select * from (select txid, vout, array_to_string(list_filter([case when value_sats is null or value_sats < 0 or value_sats > 9000000 then 'AMOUNT' end,
  case when address is null or not regexp_matches(address, '^A[0-9]+$') then 'ADDRESS' end, case when spend_height is not null and spend_txid is null then 'SPENDER' end,
  case when spend_height < block_height then 'HEIGHT' end], lambda x: x is not null), ',') as reasons from txo) where reasons <> ''""")
def ingest_quarantine(v):
    return X.quarantine(v.txo, max_sats=9_000_000)


@query("tx_metrics", "tx txi", """
select t.txid, ceil(weight / 4)::bigint as vsize, floor(fee * 10 / ceil(weight / 4) + 0.5)::bigint as fee_rate_x10, coalesce(rbf, false) as rbf, coalesce(n_in, 0) as n_in
from tx t left join (select txid, count(*) as n_in, bool_or(sequence < 4294967294) as rbf from txi group by txid) i on i.txid = t.txid""")
def tx_metrics(v):
    return X.tx_metrics(v.tx, v.txi)


@query("fee_bands", "tx", """
select case when r < 3 then 'low' when r <= 15 then 'average' when r <= 80 then 'high' else 'very_high' end as band, count(*) as txs, sum(fee)::bigint as fees
from (select fee, fee / ceil(weight / 4) as r from tx) group by 1""")
def fee_bands(v):
    return X.fee_bands(v.tx)


@query("utxo_age", "txo tx", f"""
select case when days < 365 then 'under 1 year' when days < 1825 then '1 to 5 years' else 'over 5 years' end as band, count(*) as outputs, sum(value_sats)::bigint as sats,
  max(days * 144 + hours * 6)::bigint as oldest_blocks
from (select value_sats, ({NOW} - block_time) // 86400 as days, ({NOW} - block_time) % 86400 // 3600 as hours from txo join tx on tx.txid = txo.txid where spend_txid is null) group by 1""")
def utxo_age(v):
    return X.utxo_age(v.txo, v.tx, NOW)


@query("script_census", "txo", """
select case script_type when 'p2pkh' then 'legacy' when 'p2sh' then 'script_hash' when 'v0_p2wpkh' then 'segwit' when 'v0_p2wsh' then 'segwit_script' when 'v1_p2tr' then 'taproot'
  when 'p2pk' then 'bare_key' else 'other' end as script, count(*) as outputs, sum(value_sats)::bigint as sats, count(distinct address) as addresses from txo group by 1""")
def script_census(v):
    return X.script_census(v.txo)


@query("identity_keys", "txo", f"select identity, count(*) as outputs from (select {_ID} as identity from txo) group by identity")
def identity_keys(v):
    return X.identity(v.txo).groupBy("identity").agg(F.count("*").alias("outputs"))


@query("custody_likelihood", "txo", f"select txid, vout, ({_CUSTODY.format(unspent='spend_txid is null')})::int as custody from txo")
def custody_likelihood(v):
    return v.txo.select("txid", "vout", L.custody_percent(F.col("address"), F.col("script_type"), F.col("spend_txid").isNotNull()).cast("int").alias("custody"))


@query("flt_dust", "txo", "select txid, vout, value_sats from (select txid, vout, value_sats % 1000 as value_sats from txo) where value_sats > 0 and value_sats < 546")
def flt_dust(v):
    return v.txo.select("txid", "vout", (F.col("value_sats") % 1000).alias("value_sats")).filter(L.is_dust(F.col("value_sats")))


@query("flt_round", "txo", "select txid, vout, value_sats from txo where value_sats > 0 and value_sats % 10000 = 0")
def flt_round(v):
    return v.txo.filter(L.is_round(F.col("value_sats"))).select("txid", "vout", "value_sats")


@query("jn_outpoint", "txo tx", """
select o.txid, o.vout, o.spend_txid, t.block_height - o.block_height as dwell from txo o left join tx t on t.txid = o.spend_txid""")
def jn_outpoint(v):
    t = v.tx.select(F.col("txid").alias("spend_txid"), F.col("block_height").alias("h"))
    return v.txo.join(t, "spend_txid", "left").select("txid", "vout", "spend_txid", (F.col("h") - F.col("block_height")).alias("dwell"))


@query("jn_self_transfer", "txo txi", _SELF)
def jn_self_transfer(v):
    return X.self_transfers(v.txo, v.txi).select("txid", "vout")


@query("jn_seen_before", "txo", _SEEN)
def jn_seen_before(v):
    return X.seen_before(v.txo).select("txid", "vout")


@query("jn_cospend_pairs", "txi", "select a.address as a, b.address as b, count(*) as txs from (select distinct txid, address from txi) a join (select distinct txid, address from txi) b on a.txid = b.txid and a.address < b.address group by 1, 2")
def jn_cospend_pairs(v):
    return X.cospend_pairs(v.txi)


@query("agg_entropy", "txo", ", d as (" + _DENOM + ") " + _ENTROPY.format(t="d"))
def agg_entropy(v):
    return X.entropy(denom(v))


@query("agg_is_mix", "txo txi", ", d as (" + _DENOM + "), e as (" + _ENTROPY.format(t="d") + """)
select e.txid from e where is_coinjoin and (select count(*) from txi where txi.txid = e.txid) >= 2 and (select count(*) from d where d.txid = e.txid) >= 2""")
def agg_is_mix(v):
    return X.is_mix(denom(v), v.txi)


@query("agg_mix_signature", "txo", ", d as (" + _DENOM + """), g as (select txid, value_sats as v, count(*) as n from d group by all),
b as (select txid, max(struct_pack(n := n, m := -v)) filter (where v > 10000) as m, sum(n) as outputs from g group by txid),
c as (select txid, m.n as anonymity_set, -m.m as matching_sats from b where outputs >= 2 and m is not null),
p as (select unnest([500000, 1000000, 5000000, 10000000, 50000000])::bigint as pool_sats),
h as (select txid, anonymity_set, matching_sats, min(pool_sats) as pool_sats from c left join p on abs(pool_sats - matching_sats) < 500 group by all),
k as (select *, (case when pool_sats is not null then least(95, 50 + anonymity_set * 12) when anonymity_set >= 4 then 85 when anonymity_set >= 3 then 70 else 0 end)::bigint as confidence from h)
select *, (anonymity_set >= 3 or (anonymity_set >= 2 and pool_sats is not null)) and confidence >= 50 as is_mix from k""")
def agg_mix_signature(v):
    return X.mix_signature(denom(v), v.spark.createDataFrame([(p,) for p in L.POOLS], "pool_sats long"))


@query("agg_conservation", "tx txi txo", """
select *, abs(delta) <= 1 as valid from (select *, (case when input_sats = 0 then 0 else input_sats - output_sats - fee end)::bigint as delta from (
  select t.txid, coalesce((select sum(value_sats) from txi where txi.txid = t.txid), 0)::bigint as input_sats, coalesce((select sum(value_sats) from txo where txo.txid = t.txid), 0)::bigint as output_sats, fee from tx t))""")
def agg_conservation(v):
    return X.conservation(v.tx, v.txi, v.txo)


@query("agg_pool_received", "txo txi", """
select address, sum(value_sats)::bigint as received_sats, count(*) as outputs, count(distinct txid) as txs from txo
where address in (select address from txi) group by rollup(address)""")
def agg_pool_received(v):
    return X.pool_received(v.txo, v.txi)


@query("agg_addr_volume", "txo txi", "select address, txid, sum(value_sats)::bigint as volume_sats from (select address, txid, value_sats from txo union all select address, txid, value_sats from txi) group by all")
def agg_addr_volume(v):
    return X.address_volume(v.txo, v.txi)


@query("agg_fee_fingerprint", "tx txi", """
, n as (select txid, count(*) as n from txi group by txid),
o as (select entity, t.txid, block_height, fee / ceil(weight / 4) as rate, case when coalesce(n, 0) <= 1 then 0 when n <= 3 then 1 else 2 end as kind from tx t left join n on n.txid = t.txid),
l as (select *, lag(rate) over w as r0, lag(kind) over w as k0, lag(txid) over w as previous from o window w as (partition by entity order by block_height, txid)),
s as (select entity, previous, txid, round(least(1.0::double, greatest(0.0::double, 0.15::double + greatest(0.0::double, 1 - abs(log10(rate) - log10(r0)) / 1.5::double) * 0.7::double
  + case when kind = k0 then 0.15::double else -0.1::double end)) * 100)::bigint as similarity from l where previous is not null)
select *, case when similarity >= 70 then 'SAME_WALLET_LIKELY' when similarity >= 40 then 'INCONCLUSIVE' else 'DISTINCT_WALLETS' end as verdict from s""")
def agg_fee_fingerprint(v):
    return X.fee_fingerprint(v.tx, v.txi)


@query("typ_sweep_tx", "placed g2", f"""
, txo as (select txid, 0 as vout, dst as address, case when txid % 3 = 0 then 'p2sh' else 'v0_p2wpkh' end as script_type, value_sats from g2 where starts_with(src, 'o')),
i as (select txid, count(*) filter (where value_sats > 0) as inputs, sum(value_sats) as input_sats from placed group by txid having count(*) filter (where value_sats > 0) >= 4),
o as (select txid, count(*) as n, sum(value_sats) as s, max(struct_pack(v := value_sats, m := -vout, address := address, script_type := script_type)) as top from txo where value_sats > 0 group by txid),
j as (select i.txid, inputs, n, top.v as swept_sats, ({_CUSTODY.format(unspent='true').replace('address', 'top.address').replace('script_type', 'top.script_type')})::bigint as custody
  from i join o on o.txid = i.txid where n <= 2 and top.v * 10 >= input_sats * 8 and (n = 1 or top.v >= (s - top.v) * 4)),
k as (select *, least(95, least(95, 55 + least(25, (inputs - 4) * 6)) + case when custody > 40 then 15 else 0 end) as c from j)
select txid, inputs, swept_sats, custody, case when custody > 40 then 'IMMINENT' else 'WATCH' end as urgency, (case when n = 2 then greatest(55, c - 5) else c end)::bigint as confidence,
  case when n = 1 then 'single-out' else 'dominant-2-out' end as shape from k""")
def typ_sweep_tx(v):
    out = v.g2.filter(F.col("src").startswith("o")).select("txid", F.lit(0).cast("long").alias("vout"), F.col("dst").alias("address"), F.when(F.col("txid") % 3 == 0, "p2sh").otherwise("v0_p2wpkh").alias("script_type"), "value_sats")
    return X.sweeps(v.placed, out)


@query("win_change_rank", "txo", """
select txid, vout, count(*) over t as n_out, (sum(value_sats) over t)::bigint as sum_out, max(value_sats) over t as max_out,
  row_number() over (partition by txid order by value_sats, vout) = 1 as smallest from txo window t as (partition by txid)""")
def win_change_rank(v):
    return X.change_context(v.txo).select("txid", "vout", "n_out", "sum_out", "max_out", "smallest")


@query("win_majority_script", "txi", _MAJ)
def win_majority_script(v):
    return X.majority_script(v.txi)


def _classified(funded: str) -> str:
    return f"""
, se as ({_SEEN}), sf as ({_SELF}), mj as ({_MAJ}), ni as (select txid, count(*) as n_in from txi group by txid),
c as (select o.*, count(*) over t as n, sum(value_sats) over t as s, max(value_sats) over t as mx, row_number() over (partition by o.txid order by value_sats, o.vout) = 1 as smallest,
  count(*) filter (where script_type <> majority) over t as alien, count(*) filter (where value_sats > 0) over t as valued, majority, coalesce(n_in, 0) as n_in, fee / ceil(weight / 4) as rate, block_time,
  sf.txid is not null as own, se.txid is not null as seen, spend_height - block_height as dwell, {funded} as funded
  from (select * from txo) o left join (select txid, fee, weight, block_time from tx) tx on tx.txid = o.txid left join mj on mj.txid = o.txid left join ni on ni.txid = o.txid
  left join sf on sf.txid = o.txid and sf.vout = o.vout left join se on se.txid = o.txid and se.vout = o.vout window t as (partition by o.txid)),
k as (select *, value_sats as v, (
  80 * (case when majority is null then 0 when script_type = majority and alien > 0 then -30 when script_type <> majority then 25 else 0 end)
  + 72 * (case when own then -50 when seen then 15 when n = 2 then -5 else 0 end)
  + 72 * (case when value_sats > 0 and value_sats % 10000 = 0 then 20 when value_sats < 546 then -10 when n = 2 and value_sats < s - value_sats and value_sats * 20 < s then 20
      when n = 2 and value_sats < s - value_sats and value_sats * 10 < s * 3 then 12 when n = 2 and value_sats > s - value_sats and value_sats * 10 > s * 7 then -15 else 0 end)
  + 48 * (case when n = 2 and vout = 0 then -3 when n = 2 then 3 when n > 2 and smallest and value_sats * n < s then -8 else 0 end)
  + 72 * (case when spend_txid is null then 35 when dwell <= 144 then -20 when dwell >= 1008 then 0 else -10 end)
  + 32 * (case when n_in = 1 and n > 2 and n <= 5 and value_sats * n < s then 10 when n_in = 1 and n > 2 and value_sats = mx then -12 when n_in >= 2 and n >= 3 then 2 else 0 end)
  + 24 * (case when block_time >= 1420070400 and rate > 80 then 8 when block_time >= 1420070400 and rate < 2 then -6 else 0 end)
  + 72 * (case when valued = 1 and value_sats > 0 and own then -20 else 0 end) + 72 * (case when funded >= 2 then 12 else 0 end))::bigint as score_milli from c),
cl as (select *, least(950000, abs(score_milli) * 1000 // 8)::bigint as confidence_ppm, case when score_milli < -1000 then 'change' when score_milli > 1000 then 'payment' else 'ambiguous' end as verdict from k)
"""


@query("gr_classify", "txo txi tx", _classified("null::bigint") + "select txid, vout, score_milli, confidence_ppm, verdict from cl", kept=True)
def gr_classify(v):
    return X.classify(v.tx, v.txi, v.txo)


@query("jn_reuse_gate", "txo txi tx", _classified("null::bigint") + f"""
, su as ({_SUM}) select txid, vout, cl.address, su.funded_txo_count from cl left join su on su.address = cl.address where abs(score_milli) <= 1000 and cl.address is not null and value_sats >= 546 and not seen and not own""", kept=True)
def jn_reuse_gate(v):
    return X.reuse_gate(X.classified(v.tx, v.txi, v.txo), X.address_summary(v.txo))


@query("gr_output_role", "txo txi tx", ", d as (" + _DENOM + "), e as (" + _ENTROPY.format(t="d") + "), mix as (select txid from e where is_coinjoin)" + _classified("null::bigint") + f"""
, r as (select cl.*, ({_CUSTODY.format(unspent='spend_txid is null')}) as custody, txid in (select txid from mix) as mix, block_height > 0 and block_height < 350000 and block_time < 1400000000 and script_type = 'p2pk' as old from cl)
select txid, vout, case when old and spend_txid is null then 'receiver' when old and own then 'change' when old and n > 1 and dwell <= 144 then 'change' when old and n > 1 and dwell >= 1008 then 'payment' when old then 'hop'
    when value_sats > 0 and value_sats < 546 then 'dust' when mix then 'mixer' when spend_txid is null and custody > 40 then 'custodial' when spend_txid is null then 'receiver' when verdict = 'change' then 'change'
    when custody > 45 then 'custodial' when verdict = 'payment' then 'payment' else 'pass_through' end as role,
  (case when old and spend_txid is null then 500000 when old and own then 550000 when old and n > 1 and (dwell <= 144 or dwell >= 1008) then 650000 when old then 500000
    when value_sats > 0 and value_sats < 546 then 920000 when mix then 400000 when spend_txid is null and custody > 40 then greatest(780000, confidence_ppm) when spend_txid is null then greatest(820000, confidence_ppm)
    when verdict = 'change' then confidence_ppm when custody > 45 then greatest(confidence_ppm, 600000) when verdict = 'payment' then greatest(confidence_ppm, 500000) else confidence_ppm end)::bigint as confidence from r""", kept=True)
def gr_output_role(v):
    mixes = X.entropy(denom(v)).filter("is_coinjoin")
    return X.output_roles(X.classified(v.tx, v.txi, v.txo), mixes)


@query("trace_confidence", "txo txi tx", _classified("null::bigint") + """
, g as (select txid, count(*) as n, sum(confidence_ppm) as s, count(*) filter (where abs(score_milli) < 1000) as ambiguous from cl group by txid),
p as (select txid, n, ambiguous, round(greatest(0.1::double, least(0.98::double, s / n / 1e6::double * greatest(0.4::double, 1 - ambiguous * 0.12::double) * greatest(0.7::double, 1 - n * 0.06::double))) * 100)::bigint as percent from g)
select *, case when percent < 55 then 'LOW' when percent < 75 then 'MEDIUM' else 'HIGH' end as level from p""", kept=True)
def trace_confidence(v):
    return X.trace_confidence(X.classify(v.tx, v.txi, v.txo), "txid")


@query("aud_order_invariance", "txo txi tx", _classified("null::bigint") + """
, f as (select *, (case when n = 2 then 48 * (case when vout = 0 then 3 else -3 end) - 48 * (case when vout = 0 then -3 else 3 end) else 0 end)
    + 48 * (case when n > 2 and row_number() over (partition by txid order by value_sats, -vout) = 1 and value_sats * n < s then -8 else 0 end)
    - 48 * (case when n > 2 and smallest and value_sats * n < s then -8 else 0 end) + score_milli as flipped from cl)
select count(*) as outputs, count(*) filter (where sign(flipped) <> sign(score_milli) and abs(score_milli) > 1000 and abs(flipped) > 1000) as flips from f""", kept=True)
def aud_order_invariance(v):
    both = X.turned(v.tx, v.txi, v.txo)
    flips = (F.signum("flipped") != F.signum("score_milli")) & (F.abs("score_milli") > 1000) & (F.abs("flipped") > 1000)
    return both.agg(F.count("*").alias("outputs"), F.count_if(flips).alias("flips"))


@query("topk_significant", "txo txi tx", """
, v as (select address, txid, sum(value_sats)::bigint as volume_sats from (select address, txid, value_sats from txo union all select address, txid, value_sats from txi) group by all),
r as (select v.*, row_number() over (partition by address order by block_height desc, v.txid desc) as rank from v join tx on tx.txid = v.txid),
p as (select *, (rank - 1) // 25 as page from r where rank <= 200),
s as (select p.*, min(page) filter (where volume_sats >= 50000000) over (partition by address) as stop from p)
select address, arg_max(txid, struct_pack(v := volume_sats, r := -rank)) as txid, max(volume_sats) as volume_sats, count(*) as scanned, max(page) + 1 as pages from s where stop is null or page <= stop group by address""")
def topk_significant(v):
    return X.significant(X.address_moves(v.txo))
