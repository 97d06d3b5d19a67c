"""Queries over value patterns, scripts, addresses and memos."""

from __future__ import annotations

from pyspark.sql import functions as F

from utxolens.functions import scripts as S
from utxolens.functions import texts as T
from utxolens.operators import graph as G
from utxolens.operators import typologies as Y
from utxolens.plans.graph import _FLOW
from utxolens.plans.registry import query

_B58 = "^[1-9A-HJ-NP-Za-km-z]+$"
_HEX40 = "substr(sha256('k' || p_partkey), 1, 40)"
_SCRIPTS = f"""select p_partkey, case p_partkey % 8 when 0 then '76a914' || {_HEX40} || '88ac' when 1 then 'a914' || {_HEX40} || '87' when 2 then '0014' || {_HEX40} when 3 then '0020' || sha256('k' || p_partkey)
  when 4 then '5120' || sha256('k' || p_partkey) when 5 then '6a' || lower(hex(p_name || '#' || p_partkey)) when 6 then '21' || '02' || sha256('k' || p_partkey) || 'ac'
  else case p_partkey // 8 % 3 when 0 then '522102' || sha256('k' || p_partkey) || '2103' || sha256('k' || p_partkey) || '52ae' when 1 then 'a914' || {_HEX40} || '87632102' || sha256('k' || p_partkey) || '670300a861b1752102' || sha256('k' || p_partkey) || '68ac'
    else '63a820' || sha256('k' || p_partkey) || '882102' || sha256('k' || p_partkey) || '6703900000b2752103' || sha256('k' || p_partkey) || '68ac' end end as script, p_size as n from part"""
_DECODED = """b as (select p_partkey, script, length(script) // 2 as n from s),
w as (select p_partkey, script, n, 0 as pos, ('0x' || script[1:2])::int as op from b where n > 0
  union all select p_partkey, script, n, q, ('0x' || script[q * 2 + 1:q * 2 + 2])::int from (select *, case when op between 1 and 75 then pos + 1 + op when op = 76 then pos + 2 + ('0x' || coalesce(nullif(script[pos * 2 + 3:pos * 2 + 4], ''), '00'))::int else pos + 1 end as q from w) where q < n)"""
_ADDR = f"""select p_partkey, case p_size % 6 when 0 then '1' || translate(substr(sha256('a' || p_partkey), 1, 30), '0', 'Z') when 1 then '3' || translate(substr(sha256('a' || p_partkey), 1, 30), '0', 'z')
  when 2 then 'bc1qw508d6qejxtdg4y5r3zarvary0c5xw7k' || case when p_partkey % 2 = 0 then 'v8f3t4' else 'v8f3t5' end
  when 3 then 'bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj' || (p_partkey % 4) when 4 then '0x' || {_HEX40} else 'junk ' || p_partkey end as address from part"""
_MEMO = """select c_custkey, case c_custkey % 7 when 0 then '=:ETH.USDT:0x' || lpad(to_hex(c_custkey), 40, '0') when 1 then 'SSH:0x' || lpad(to_hex(c_custkey), 40, '0') || ':usdt' when 2 then 'BRIDGE:SOL:dest' || c_custkey || ':sol'
  when 3 then case c_custkey // 7 % 4 when 0 then 'plain text ' || c_custkey when 1 then '6a' || lpad(to_hex(length('=:ETH.ETH:d' || c_custkey)), 2, '0') || hex('=:ETH.ETH:d' || c_custkey)
    when 2 then 'send to T' || translate(substr(sha256('t' || c_custkey), 1, 33), '0', 'Z') else 'sol wallet: ' || translate(substr(sha256('t' || c_custkey), 1, 40), '0', 'Z') end
  when 4 then 'm:BTC.BTC:bc1' || c_custkey when 5 then 'pay 0x' || lpad(to_hex(c_custkey), 40, 'a') else 'OP_RETURN SWAP:target' || c_custkey end as memo, round(c_acctbal * 100)::bigint as value_sats from customer"""


def scripts(v):
    key = F.col("p_partkey").cast("string")
    digest = F.sha2(F.concat(F.lit("k"), key), 256)
    h40 = F.substring(digest, 1, 40)
    kinds = [F.concat(F.lit("76a914"), h40, F.lit("88ac")), F.concat(F.lit("a914"), h40, F.lit("87")), F.concat(F.lit("0014"), h40), F.concat(F.lit("0020"), digest), F.concat(F.lit("5120"), digest), F.concat(F.lit("6a"), F.lower(F.hex(F.concat("p_name", F.lit("#"), key)))), F.concat(F.lit("2102"), digest, F.lit("ac"))]
    funding = F.concat(F.lit("522102"), digest, F.lit("2103"), digest, F.lit("52ae"))
    service = F.concat(F.lit("a914"), h40, F.lit("87632102"), digest, F.lit("670300a861b1752102"), digest, F.lit("68ac"))
    locked = F.concat(F.lit("63a820"), digest, F.lit("882102"), digest, F.lit("6703900000b2752103"), digest, F.lit("68ac"))
    third = F.floor(F.col("p_partkey") / 8) % 3
    script = F.when(third == 0, funding).when(third == 1, service).otherwise(locked)
    for i, k in enumerate(kinds):
        script = F.when(F.col("p_partkey") % 8 == i, k).otherwise(script)
    return v.table("part").select("p_partkey", script.alias("script"), F.col("p_size").alias("n"))


def addresses(v):
    digest = F.substring(F.sha2(F.concat(F.lit("a"), F.col("p_partkey").cast("string")), 256), 1, 30)
    one, three = F.concat(F.lit("1"), F.translate(digest, "0", "Z")), F.concat(F.lit("3"), F.translate(digest, "0", "z"))
    q = F.concat(F.lit("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7k"), F.when(F.col("p_partkey") % 2 == 0, "v8f3t4").otherwise("v8f3t5"))
    p = F.concat(F.lit("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj"), (F.col("p_partkey") % 4).cast("string"))
    evm = F.concat(F.lit("0x"), F.substring(F.sha2(F.concat(F.lit("k"), F.col("p_partkey").cast("string")), 256), 1, 40))
    kind = F.col("p_size") % 6
    text = F.when(kind == 0, one).when(kind == 1, three).when(kind == 2, q).when(kind == 3, p).when(kind == 4, evm).otherwise(F.concat(F.lit("junk "), F.col("p_partkey").cast("string")))
    return v.table("part").select("p_partkey", text.alias("address"))


def memos(v):
    k, key = F.col("c_custkey") % 7, F.col("c_custkey")
    hexes = F.hex(key)
    evm = F.concat(F.lit("0x"), F.lpad(hexes, 40, "0"))
    swap, digest, part = F.concat(F.lit("=:ETH.ETH:d"), key.cast("string")), F.sha2(F.concat(F.lit("t"), key.cast("string")), 256), F.floor(key / 7) % 4
    tron, sol = F.concat(F.lit("send to T"), F.translate(F.substring(digest, 1, 33), "0", "Z")), F.concat(F.lit("sol wallet: "), F.translate(F.substring(digest, 1, 40), "0", "Z"))
    odd = F.when(part == 0, F.concat(F.lit("plain text "), key.cast("string"))).when(part == 1, F.concat(F.lit("6a"), F.lpad(F.hex(F.length(swap)), 2, "0"), F.hex(swap))).when(part == 2, tron).otherwise(sol)
    text = F.when(k == 0, F.concat(F.lit("=:ETH.USDT:"), evm)).when(k == 1, F.concat(F.lit("SSH:"), evm, F.lit(":usdt"))).when(k == 2, F.concat(F.lit("BRIDGE:SOL:dest"), key.cast("string"), F.lit(":sol"))).when(k == 3, odd)
    text = text.when(k == 4, F.concat(F.lit("m:BTC.BTC:bc1"), key.cast("string"))).when(k == 5, F.concat(F.lit("pay 0x"), F.lpad(hexes, 40, "a"))).otherwise(F.concat(F.lit("OP_RETURN SWAP:target"), key.cast("string")))
    return v.table("customer").select("c_custkey", text.alias("memo"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value_sats"))


@query("script_templates", "", f"""with s as ({_SCRIPTS}) select case when regexp_matches(script, '^76a914[0-9a-f]{{40}}88ac$') then 'legacy' when regexp_matches(script, '^a914[0-9a-f]{{40}}87$') then 'script hash' when regexp_matches(script, '^0014[0-9a-f]{{40}}$') then 'segwit'
  when regexp_matches(script, '^0020[0-9a-f]{{64}}$') then 'segwit script' when regexp_matches(script, '^5120[0-9a-f]{{64}}$') then 'taproot' when starts_with(script, '6a') then 'data' when regexp_matches(script, '^(41|21)[0-9a-f]+ac$') then 'bare key' else 'custom' end as template,
  count(*) as scripts, sum(n)::bigint as n from s group by 1""")
def script_templates(v):
    return scripts(v).groupBy(T.template(F.col("script")).alias("template")).agg(F.count("*").alias("scripts"), F.sum("n").alias("n"))


@query("op_return_texts", "", "select p_name || '#' || p_partkey as text, count(*) as n from part where p_partkey % 8 = 5 group by 1")
def op_return_texts(v):
    return scripts(v).withColumn("text", T.carried_text(F.col("script"))).filter("text is not null").groupBy("text").agg(F.count("*").alias("n"))


@query("l2_exits", "", f"""with recursive s as ({_SCRIPTS}), {_DECODED},
o as (select p_partkey, list(op order by pos) as ops from w group by p_partkey),
h as (select *, list_has_any(ops, [168, 169]) and list_has_any(ops, [177, 178]) and list_has_any(ops, [99, 103, 104]) or list_has_all(ops, [169, 177]) or list_has_all(ops, [99, 103, 177]) as swap,
  len(list_filter(range(1, len(ops)), lambda i: ops[i] = 135 and ops[i + 1] = 99)) > 0 and len(list_filter(range(1, len(ops)), lambda i: ops[i] = 177 and ops[i + 1] = 117)) > 0 as service from o)
select case when ops[-5:] = [82, 33, 33, 82, 174] then 'channel funding' when swap and service then 'swap service' when swap then 'hash-locked swap' else 'none' end as protocol, count(*) as scripts from h group by 1""")
def l2_exits(v):
    return scripts(v).select(S.layer_two(F.col("script")).alias("protocol")).groupBy("protocol").agg(F.count("*").alias("scripts"))


@query("address_quality", "", f"""with recursive a as ({_ADDR}),
v as (select *, list_transform(range(4, length(address) + 1), lambda i: strpos('qpzry9x8gf2tvdw0s3jn54khce6mua7l', address[i]) - 1) as x from a),
c as (select *, case when starts_with(address, 'bc1') then list_reduce(x, lambda k, y: xor(xor(xor(xor(xor(xor((k & 33554431) << 5, y), case when (k >> 25) & 1 = 1 then 996825010 else 0 end), case when (k >> 26) & 1 = 1 then 642813549 else 0 end),
   case when (k >> 27) & 1 = 1 then 513874426 else 0 end), case when (k >> 28) & 1 = 1 then 1027748829 else 0 end), case when (k >> 29) & 1 = 1 then 705979059 else 0 end),
   list_reduce([3, 3, 0, 2, 3]::bigint[], lambda k, y: xor((k & 33554431) << 5, y), 1::bigint)) end as chk from v)
select case when starts_with(address, 'bc1q') then case when chk = 1 then 'segwit' else 'invalid: checksum' end when starts_with(address, 'bc1p') then case when list_contains(x, -1) then 'invalid: structure' when chk = 734539939 then 'taproot' else 'invalid: checksum' end
  when starts_with(address, '1') or starts_with(address, '3') then case when regexp_matches(address, '{_B58}') and length(address) between 26 and 35 then case when starts_with(address, '1') then 'legacy' else 'script' end else 'invalid: characters or length' end
  else 'invalid: unknown' end as type, count(*) as addresses from c group by 1""")
def address_quality(v):
    return T.with_address_type(addresses(v), "address").groupBy("type").agg(F.count("*").alias("addresses"))


@query("address_networks", "", f"""with a as ({_ADDR}) select case when regexp_matches(address, '^0x[0-9a-fA-F]{{40}}$') then 'EVM' when regexp_matches(address, '^T[1-9A-HJ-NP-Za-km-z]{{33}}$') then 'TRON' when regexp_matches(address, '^(bc1|[13])') then 'BTC'
  when regexp_matches(address, '^[1-9A-HJ-NP-Za-km-z]{{32,44}}$') then 'SOL' else 'none' end as network, count(*) as addresses from a group by 1""")
def address_networks(v):
    return addresses(v).groupBy(T.network_of(F.col("address")).alias("network")).agg(F.count("*").alias("addresses"))


@query("flt_joinable", "", f"with a as ({_ADDR}) select p_partkey, address from a where regexp_matches(address, '^[13]') and regexp_matches(address, '{_B58}') and length(address) between 26 and 35")
def flt_joinable(v):
    return T.with_address_type(addresses(v), "address").filter(F.col("type").isin("legacy", "script")).drop("type")


@query("bridge_memos", "", f"""with m as ({_MEMO}), k as (select *, c_custkey % 7 as k, c_custkey // 7 % 4 as j from m)
select case when k = 3 then case j when 1 then 'THORChain' when 2 then 'TRON' else 'Solana' end when k = 0 then 'THORChain' when k = 1 then 'SideShift' when k = 4 then 'Maya' when k = 5 then 'EVM' else 'Bridge' end as protocol,
  case when k = 3 then case j when 1 then 'ETH' when 2 then 'TRX' else 'SOL' end when k in (0, 1, 5) then 'ETH' when k = 2 then 'SOL' when k = 4 then 'BTC' else 'UNKNOWN' end as chain,
  count(*) as memos, sum(value_sats)::bigint as sats, count(distinct memo) as destinations from k where k <> 3 or j <> 0 group by 1, 2""")
def bridge_memos(v):
    return Y.bridge_exits(memos(v))


@query("jn_entity_tag", "", f"""with a as ({_ADDR}), e as (select lower(address) as k, min('entity ' || p_partkey % 5) as entity from a where p_partkey % 3 = 0 and length(address) >= 30 group by 1)
select a.address, coalesce(e.entity, case when starts_with(a.address, '3') then 'script custody?' when starts_with(a.address, 'bc1p') then 'taproot custody?' end) as tag, e.entity is not null as verified from a left join e on e.k = lower(a.address)""")
def jn_entity_tag(v):
    a = addresses(v)
    known = a.select(F.col("address").alias("entity_address"), F.concat(F.lit("entity "), (F.col("p_partkey") % 5).cast("string")).alias("entity"), (F.col("p_partkey") % 3 == 0).alias("verified"))
    return Y.entity_tags(a.select("address"), known)


_BANDS = """
, d as (select src, value_sats as v from g2 where starts_with(src, 's') and value_sats >= 546),
o as (select src, v, row_number() over (partition by src order by v) as i from d),
w as (select src, 1::bigint as i, v, 1::bigint as n, v::hugeint as s, v as low, 1::bigint as band from o where i = 1
  union all select o.src, o.i, o.v, case when (o.v * w.n - w.s) * 20 <= w.s then w.n + 1 else 1 end, case when (o.v * w.n - w.s) * 20 <= w.s then w.s + o.v else o.v end,
    case when (o.v * w.n - w.s) * 20 <= w.s then w.low else o.v end, case when (o.v * w.n - w.s) * 20 <= w.s then w.band else w.band + 1 end from w join o on o.src = w.src and o.i = w.i + 1),
b as (select src, band, max(n) as n, max(s) as s, max(v) as high from w group by src, band),
t as (select src, sum(v) as total, count(*) as c from d group by src),
k as (select b.* from b join t on t.src = b.src where n >= 3 and high <= 50000000 and s * 200 >= total and c >= 3),
z as (select src, count(*) as bands, max(struct_pack(n := n, m := -s)) as top from k group by src)
select src, bands, top.n as largest, floor(-top.m / top.n + 0.5)::bigint as mean_sats,
  least(95, 25 + least(55, (top.n - 2) * 18) + case when floor(-top.m / top.n + 0.5) < 25000000 then 15 else 5 end + case when bands > 1 then 10 else 0 end)::bigint as confidence from z"""


@query("fold_bands", "g2", _BANDS)
def fold_bands(v):
    return Y.value_bands(v.g2.filter("src like 's%'"), ["src"])


@query("fold_peel_tx", "txo tx", """
, h as (select entity, block_height as ord, o.txid, list_sort(list(value_sats)) as vs, sum(value_sats) as total from txo o join (select txid, entity from tx) t on t.txid = o.txid group by all),
p as (select *, vs[len(vs)] as top, (len(vs) = 2 and vs[1] * 1000 >= total * 8 and vs[1] * 100 <= total * 45) or (len(vs) between 3 and 5 and vs[len(vs)] * 10 >= total * 6
  and len(list_filter(vs[1:len(vs) - 1], lambda x: x * 10 >= total * 3)) = 0 and len(list_filter(vs[1:len(vs) - 1], lambda x: x >= 546)) > 0) as peel,
  floor((total - vs[len(vs)]) * 1000 / total + 0.5)::bigint as tenths from h where len(vs) >= 2),
s as (select *, row_number() over (partition by entity order by ord, txid) as i from p),
w as (select entity, 0::bigint as i, null::bigint as last, 0::bigint as n, 0::bigint as sum, true as falls from (select distinct entity from s)
  union all select s.entity, s.i, case when ok then s.top else w.last end, case when ok then w.n + 1 else w.n end, case when ok then w.sum + s.tenths else w.sum end, case when ok then w.falls and (w.last is null or s.top <= w.last) else w.falls end
  from w join s on s.entity = w.entity and s.i = w.i + 1, lateral (select s.peel and (w.last is null or s.top * 100 <= w.last * 102) as ok)),
f as (select entity, arg_max(struct_pack(n := n, sum := sum, falls := falls), i) as z from w group by entity)
select entity, z.n as hops, z.sum // z.n as mean_tenths, least(96, 58 + z.n * 9 + case when z.n >= 3 and z.falls then 8 else 0 end)::bigint as confidence from f where z.n >= 2""")
def fold_peel_tx(v):
    hops = v.txo.groupBy("txid", F.col("block_height").alias("ord")).agg(F.collect_list("value_sats").alias("values")).join(v.tx.select("txid", "entity"), "txid")
    return Y.peel_chains(hops)


@query("typ_sweep_graph", "g2", f", fl as ({_FLOW}) select case_id, node, in_degree, inflow, outflow, case when out_degree = 1 then 88 else 70 end::bigint as confidence from fl where in_degree >= 4 and out_degree between 1 and 2 and outflow * 10 >= inflow * 8")
def typ_sweep_graph(v):
    return Y.graph_sweeps(G.flows(v.g2))


@query("typ_peel_graph", "g2", f""", fl as ({_FLOW}), o as (select *, outflow > 0 and outflow * 100 <= inflow * 105 as ok, in_degree = 1 and out_degree = 1 as lin from fl where starts_with(node, 'o')),
a as (select case_id, count(*) as hops, count(*) filter (where ok) as compliant, count(*) filter (where lin) as linear, (sum(inflow - outflow) filter (where ok))::bigint as peeled_sats from o group by case_id)
select *, compliant >= 2 or (linear >= 3 and compliant >= linear - 1) as is_peel from a""")
def typ_peel_graph(v):
    return Y.graph_peels(G.flows(v.g2), v.g2.filter("src like 'o%'").select("case_id", F.col("src").alias("node")).distinct())
