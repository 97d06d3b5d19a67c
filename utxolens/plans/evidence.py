"""Queries over evidence: graph records, unmixing, claims, gaps, audits, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from utxolens.operators import cases as C
from utxolens.operators import evidence as E
from utxolens.operators import transactions as X
from utxolens.operators import typologies as Y
from utxolens.operators.iterate import shared_dir
from utxolens.plans.cases import edges, nodes
from utxolens.plans.registry import query
from utxolens.plans.transactions import _DENOM, _ENTROPY, _classified, denom
from utxolens.plans.typologies import _DECODED, _SCRIPTS, scripts
from utxolens.sources import imports as I


def folder(v) -> str:
    return f"{shared_dir(v.spark)}/export-{uuid.uuid4().hex}"


@query("graph_build", "tx txi txo", """, n as (select txid, 'tx_' || txid as node_id, case when txid % 9 = 0 then 'mixer' else 'hop' end as type, sum(value_sats)::bigint as balance_sats from txo group by txid
union all select txid, 'in_' || address, 'suspect', sum(value_sats)::bigint from txi group by txid, address
union all select txid, case when row_number() over (partition by txid, address order by vout) > 1 then 'out_utxo_' || txid || '_' || vout else 'out_' || address end, case when spend_txid is null then 'receiver' else 'hop' end, value_sats from txo) select * from n""")
def graph_build(v):
    return E.graph_nodes(v.tx, v.txi, v.txo, v.tx.filter("txid % 9 = 0"))


@query("opcode_census", "", f"""with recursive s as ({_SCRIPTS}), {_DECODED}
select op as opcode, count(*) as n from w group by op""")
def opcode_census(v):
    return E.opcodes(scripts(v))


_MIX = ", d as (" + _DENOM + "), e as (" + _ENTROPY.format(t="d") + "), mx as (select txid, modal_sats, equal_outputs from e where is_coinjoin)"
_CAND = _MIX + """, ii as (select txid, list(struct_pack(i := vin, v := value_sats * 5) order by vin) as i from txi where txid in (select txid from mx) group by txid having count(*) <= 16),
mk as (select txid, mask, list_sum(list_transform(i, lambda x: case when (mask >> x.i::int) & 1 = 1 then x.v else 0 end))::bigint as total from (select *, unnest(range(1, (1 << len(i))::bigint)) as mask from ii)),
ch as (select d.txid, vout as change_vout, d.value_sats as change from d join mx on mx.txid = d.txid where d.value_sats <> modal_sats union all select txid, -1, 0 from mx)
select mk.txid, mask::int as mask, change_vout, total - modal_sats - change as fee from mk join mx on mx.txid = mk.txid join ch on ch.txid = mk.txid where total - modal_sats - change between -400000 and 400000"""


def mixes(v):
    return X.entropy(denom(v)).filter("is_coinjoin").select("txid", "modal_sats", "equal_outputs")


def candidates(v):
    few = v.txi.withColumn("value_sats", F.col("value_sats") * 5)
    return E.unmix_candidates(mixes(v), few, denom(v), -400_000, 400_000, 16)


@query("jn_unmix_candidates", "txi txo", _CAND)
def jn_unmix_candidates(v):
    return candidates(v)


@query("jn_unmix_partitions", "txi txo", _CAND.replace("select mk.txid, mask::int", ", cd as (select mk.txid, mask::int") + """),
ow as (select *, row_number() over (partition by txid order by mask, change_vout) as k from (select distinct txid, mask, change_vout from cd)),
tr as (select ow.txid, mask as used, [change_vout] as ch, k, 1::bigint as n, equal_outputs as need from ow join mx on mx.txid = ow.txid
  union all select tr.txid, used | mask, list_append(ch, change_vout), ow.k, n + 1, need from tr join ow on ow.txid = tr.txid and ow.k > tr.k where n < need and used & mask = 0 and (change_vout = -1 or not list_contains(ch, change_vout))),
so as (select txid, count(*) as n from tr where n = need group by txid),
al as (select mx.txid, least(coalesce(so.n, 0), 11)::bigint as s, exists (select 1 from ii where ii.txid = mx.txid) as tried from mx left join so on so.txid = mx.txid)
select txid, s as solutions, case when not tried then 'untried' when s = 0 then 'unsolved' when s = 1 then 'unique' else 'ambiguous' end as verdict, (case when tried then case when s = 0 then 30 when s = 1 then 92 when s <= 10 then 75 else 55 end end)::bigint as confidence from al""")
def jn_unmix_partitions(v):
    tried = v.txi.groupBy("txid").agg(F.count("*").alias("n")).filter("n <= 16")
    return E.unmix_partitions(candidates(v), mixes(v), tried=tried)


@query("typ_bridge_case", "case_node", """, f as (select *, substr(address, 2)::bigint as part from case_node),
u as (select case_id, lower(address) as a, ord, value_sats, 'ETH' as chain, 0 as s from f where type = 'bridge' union all select case_id, lower(address), ord, value_sats, 'TRX', 1 from f where part % 37 = 0 union all select case_id, lower(address), ord, value_sats, 'SOL', 2 from f where part % 41 = 0),
o as (select case_id, a, arg_min(struct_pack(v := value_sats, c := chain), struct_pack(s := s, o := ord)) as f from u group by all)
select case_id, count(*) as bridges, max(f.v) as max_sats, array_to_string(list_sort(list(distinct f.c)), ',') as chains, least(30, 15 * count(*))::bigint as penalty from o group by case_id""")
def typ_bridge_case(v):
    n, part = nodes(v), F.expr("cast(substring(address, 2) as bigint)")
    source = lambda when, chain: n.filter(when).withColumn("chain", F.lit(chain))
    return Y.bridge_cases(source(F.col("type") == "bridge", "ETH"), source(part % 37 == 0, "TRX"), source(part % 41 == 0, "SOL"))


@query("set_claims", "case_node", """, dv as (select case_id, 'onchain:' || address as id, case when type = 'hop' then 'on_chain_reference' else 'hypothesis' end as class, ord as seq from case_node),
o as (select case_id, id, arg_max(class, seq) as class, 'derived' as origin from dv group by case_id, id union all select case_id, 'stored:' || ord, 'entered', 'investigator_entered' from case_node where ord % 9 = 0)
select o.*, coalesce(r.review, 'unreviewed') as review from o left join (select distinct case_id, 'onchain:' || address as id, 'accepted' as review from case_node where substr(address, 2)::bigint % 4 = 0) r on r.case_id = o.case_id and r.id = o.id""")
def set_claims(v):
    n = nodes(v)
    derived = n.select("case_id", F.concat(F.lit("onchain:"), "address").alias("id"), F.when(F.col("type") == "hop", "on_chain_reference").otherwise("hypothesis").alias("class"), F.col("ord").alias("seq"))
    stored = n.filter("ord % 9 = 0").select("case_id", F.concat(F.lit("stored:"), F.col("ord").cast("string")).alias("id"), F.lit("entered").alias("class"), F.col("ord").alias("seq"))
    reviews = n.filter(F.expr("cast(substring(address, 2) as bigint) % 4 = 0")).select("case_id", F.concat(F.lit("onchain:"), "address").alias("id"), F.lit("accepted").alias("review")).distinct()
    return E.claims(derived, stored, reviews)


def _gap_sql() -> str:
    case = [f"select case_id, 'case' as subject, '{g}' as gap, {p} as priority from c where k % {i + 2} = 0" for i, (g, p) in enumerate(E.CASE_GAPS.values())]
    names = list(E.RECEIVER_GAPS.values())
    one = [f"select case_id, address, '{g}', {p} from r where {w}" for (g, p), w in zip(names, ("part % 2 = 0", "part % 3 = 0", "part % 5 = 0", "part % 5 <> 0 and part % 7 = 0"), strict=True)]
    return ", c as (select distinct case_id, substr(case_id, 2)::bigint // 3 as k from case_node), r as (select case_id, address, substr(address, 2)::bigint as part from case_node where type = 'receiver') " + " union all ".join(case + one)


@query("set_gaps", "case_node", _gap_sql())
def set_gaps(v):
    n = nodes(v)
    k, part = F.expr("cast(substring(case_id, 2) as bigint) div 3"), F.expr("cast(substring(address, 2) as bigint)")
    flags = n.select("case_id").distinct().select("case_id", *[(k % (i + 2) != 0).alias(c) for i, c in enumerate(E.CASE_GAPS)])
    receivers = n.filter("type = 'receiver'").select("case_id", "address", *[(part % m != 0).alias(c) for m, c in zip((2, 3, 5, 7), E.RECEIVER_GAPS, strict=True)])
    return E.gaps(flags, receivers)


@query("aud_heuristic", "txo txi tx", _classified("null::bigint") + """, l as (select *, case (txid + vout) % 3 when 0 then 'payment' when 1 then 'change' end as label from cl)
select txid, vout, case when value_sats % 1000 < 546 and value_sats % 1000 > 0 and spend_txid is null then 'DUST_RECEIVER' else 'CONTRADICTION' end as finding from l
where (label = 'change' and score_milli > 2000) or (label = 'payment' and score_milli < -2000) or (value_sats % 1000 < 546 and value_sats % 1000 > 0 and spend_txid is null)""", kept=True)
def aud_heuristic(v):
    k, small = (F.col("txid") + F.col("vout")) % 3, F.col("value_sats") % 1000
    own = X.classified(v.tx, v.txi, v.txo)
    dust = (small < 546) & (small > 0) & F.col("spend_txid").isNull()
    against = ((k == 1) & (F.col("score_milli") > 2000)) | ((k == 0) & (F.col("score_milli") < -2000))
    return own.filter(dust | against).select("txid", "vout", F.when(dust, "DUST_RECEIVER").otherwise("CONTRADICTION").alias("finding"))


@query("aud_trace", "case_node case_edge", """, f as (select case_id, node, sum(i) as inflow, sum(o) as outflow from (select case_id, dst as node, value_sats as i, 0 as o from case_edge union all select case_id, src, 0, value_sats from case_edge) group by all),
a as (select c.case_id, case when exists (select 1 from f where f.case_id = c.case_id and inflow > 0 and outflow > 0 and (inflow - outflow > 20000000 and (inflow - outflow) * 2 > inflow or outflow > inflow)) then 'failed' else 'passed' end as value,
  case when exists (select 1 from case_edge e where e.case_id = c.case_id and dst_height < src_height) then 'failed' else 'passed' end as time, case when substr(c.case_id, 2)::bigint % 4 = 0 then null else 'passed' end as taint, case when c.m then 'failed' else 'passed' end as heuristic
  from (select case_id, bool_or(type = 'mixer') as m from case_node group by case_id) c)
select case_id, case when taint is null then null else greatest(0, 100 - case when value = 'failed' then 35 else 0 end - case when time = 'failed' then 25 else 0 end - case when heuristic = 'failed' then 15 else 0 end) end::bigint as score,
  case when taint is null then 'INCOMPLETE' when value = 'failed' or time = 'failed' or heuristic = 'failed' then 'INCONSISTENT' else 'CONSISTENT' end as rating from a""")
def aud_trace(v):
    e, n = edges(v), nodes(v)
    hubs = e.select("case_id", F.col("src").alias("node")).distinct()
    value = C.audit_value(e, hubs).select("case_id").distinct().withColumn("v", F.lit(True))
    late = C.audit_time(e).select("case_id").distinct().withColumn("t", F.lit(True))
    own = n.groupBy("case_id").agg(F.bool_or(F.col("type") == "mixer").alias("m")).join(value, "case_id", "left").join(late, "case_id", "left")
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), "failed").otherwise("passed")
    own = own.select("case_id", flag("v").alias("value"), flag("t").alias("time"), F.when(F.expr("cast(substring(case_id, 2) as bigint) % 4 != 0"), "passed").alias("taint"), flag("m").alias("heuristic"))
    return E.master_audit(own)


@query("aud_labels", "tx", """select txid, array_to_string(list_filter([case when txid % 5 = 0 then 'STATUS' end, case when fee < 300 then 'SOURCES' end, case when weight > 3900 then 'DIGEST' end], lambda x: x is not null), ',') as errors from tx where txid % 5 = 0 or fee < 300 or weight > 3900""")
def aud_labels(v):
    errors = F.array_compact(F.array(F.when(F.col("txid") % 5 == 0, "STATUS"), F.when(F.col("fee") < 300, "SOURCES"), F.when(F.col("weight") > 3900, "DIGEST")))
    return v.tx.select("txid", F.array_join(errors, ",").alias("errors")).filter("errors != ''")


_TRUTH = """, ex as (select 'C' || entity as case_id, o.txid, vout, address, case when vout % 7 <> 6 then value_sats end as value_sats, case when denom_sats * 2 < value_sats then 'change' else 'payment' end as role,
  case when spend_txid is null then 'end_receiver' when vout % 3 = 0 then 'intermediate' when denom_sats * 2 < value_sats then 'change' else 'payee' end as node_role from txo o join tx on tx.txid = o.txid where script_type <> 'p2sh'),
pr as (select 'C' || entity as case_id, o.txid, vout, case when vout = 5 then 'B' || substr(address, 2) else address end as a, value_sats + case when vout = 4 then 1 else 0 end as v,
  case when denom_sats < 12000000 then 'change' when denom_sats >= 32000000 then 'payment' end as k, case when spend_txid is null then 'end_receiver' when spend_height - o.block_height < 14400 then 'intermediate' else 'boundary' end as p
  from txo o join tx on tx.txid = o.txid where script_type <> 'p2pkh'),
j as (select coalesce(ex.case_id, pr.case_id) as case_id, ex.role, node_role, pr.k, pr.p, pr.txid is not null as there, coalesce(ex.address = pr.a and (ex.value_sats is null or ex.value_sats = pr.v), false) as fits
  from ex full join pr on pr.case_id = ex.case_id and pr.txid = ex.txid and pr.vout = ex.vout),
g as (select case_id, grouping(case_id)::int as total, count(role) as expected, count(*) filter (where there) as predicted, count(*) filter (where fits) as matched, count(*) filter (where fits and k is not null) as classified, count(*) filter (where fits and k = role) as right_class,
  count(*) filter (where fits and case node_role when 'payee' then k = 'payment' when 'change' then k = 'change' else p = node_role end) as right_role,
  count(*) filter (where fits and case when node_role in ('payee', 'change') then k is not null else p <> 'boundary' end) as known_role from j group by grouping sets ((case_id), ()))
select *, case when predicted > 0 then matched * 1000000 // predicted else 0 end as precision_ppm, case when expected > 0 then matched * 1000000 // expected else 0 end as recall_ppm, case when predicted + expected > 0 then 2000000 * matched // (predicted + expected) else 0 end as f1_ppm,
  case when classified > 0 then right_class * 1000000 // classified end as class_ppm, case when expected > 0 then right_role * 1000000 // expected end as role_ppm, case when expected > 0 then known_role * 1000000 // expected else 0 end as coverage_ppm
from g where total = 0 or expected + predicted > 0"""


@query("eval_ground_truth", "txo tx", _TRUTH)
def eval_ground_truth(v):
    """Reviewed labels by value and face value, predictions by face value and spend; some addresses and values are told wrongly."""
    own = v.txo.join(v.tx.select("txid", F.concat(F.lit("C"), F.col("entity").cast("string")).alias("case_id")), "txid")
    large = F.col("denom_sats") * 2 < F.col("value_sats")
    unspent, key = F.col("spend_txid").isNull(), ["case_id", "txid", "vout"]
    node_role = F.when(unspent, "end_receiver").when(F.col("vout") % 3 == 0, "intermediate").when(large, "change").otherwise("payee")
    expected = own.filter("script_type != 'p2sh'").select(*key, "address", F.when(F.col("vout") % 7 != 6, F.col("value_sats")).alias("value_sats"), F.when(large, "change").otherwise("payment").alias("role"), node_role.alias("node_role"))
    address = F.when(F.col("vout") == 5, F.concat(F.lit("B"), F.substring("address", 2, 100))).otherwise(F.col("address"))
    value = F.col("value_sats") + F.when(F.col("vout") == 4, 1).otherwise(0)
    kind = F.when(F.col("denom_sats") < 6_000_000, "change").when(F.col("denom_sats") >= 45_000_000, "receiver")
    score = F.when(F.col("denom_sats") < 12_000_000, -2).when(F.col("denom_sats") >= 32_000_000, 2).otherwise(0)
    followed = F.coalesce(F.col("spend_height") - F.col("block_height") < 14_400, F.lit(False))
    predicted = own.filter("script_type != 'p2pkh'").select(*key, address.alias("address"), value.alias("value_sats"), kind.alias("kind"), score.alias("score"), (~unspent).alias("spent"), followed.alias("followed"))
    return C.ground_truth(expected, predicted)


@query("src_case_json", "case_node", "select case_id as id, count(*) as nodes, sum(value_sats)::bigint as sats from case_node group by case_id order by id limit 50")
def src_case_json(v):
    path = folder(v)
    own = nodes(v).groupBy(F.col("case_id").alias("id")).agg(F.collect_list(F.struct("address", "value_sats")).alias("nodes"))
    I.write_json(own, path)
    found = I.read_cases(v.spark, path, "id string, nodes array<struct<address: string, value_sats: bigint>>", multi_line=False)
    return found.select("id", F.size("nodes").cast("long").alias("nodes"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + x["value_sats"]).alias("sats"))


@query("sink_json", "case_node", "select case_id, count(*) as n from case_node group by case_id")
def sink_json(v):
    path = folder(v)
    I.write_json(nodes(v), path)
    return v.spark.read.schema("case_id string").json(path).groupBy("case_id").agg(F.count("*").alias("n"))


@query("snap_write", "case_node", "select case_id, count(*) as rows, '2002-01-01' as captured_at from case_node group by case_id")
def snap_write(v):
    path = folder(v)
    I.write_snapshot(nodes(v), path, "2002-01-01")
    return v.spark.read.parquet(path).groupBy("case_id", F.col("captured_at").cast("string").alias("captured_at")).agg(F.count("*").alias("rows"))
