"""Leads of the supplier-order-customer graph: customers are destinations, two to an address, with evidence from their own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from utxolens.operators import recovery as R
from utxolens.plans.graph import _MODELS, seeds
from utxolens.plans.registry import query

NOW = 904_608_000  # 1998-09-01
_ENDS = f"""
select c_mktsegment as case_id, 'c' || c_custkey as node, 'D' || c_custkey // 2 as address, greatest(0, round(c_acctbal * 1000))::bigint as balance_sats,
  case when c_acctbal < 0 then true when c_nationkey % 2 = 0 then false end as spent, case when c_nationkey % 4 in (0, 3) then ['exchange', '', '', 'custodian'][c_nationkey % 4 + 1] end as held,
  case c_nationkey % 5 when 0 then 0.7::double when 1 then 0.9::double when 2 then 0.4::double else 0.0::double end as attributed,
  case when c_nationkey % 3 <> 0 then 0.0::double when c_nationkey = 0 then 0.5::double when c_nationkey * 20 <= 90 then 1.0::double else 0.25::double end as reached from customer"""
_LEADS = (
    f""", lk as (select g.*, case when g.case_id = 'MACHINERY' and g.txid % 1000 = 1 then null else g.txid end as ref, t.block_time as seen from g2 g join tx t on t.txid = g.txid),
gd as (select case_id, src, dst, value_sats, ref, min(edge_idx) as edge_idx, min(seen) as seen from lk group by case_id, src, dst, value_sats, ref, case when ref is null then edge_idx end)"""
    + _MODELS.replace("g2 ", "gd ")
    + f""", en as ({_ENDS}), am as (select case_id, bool_or(ref is null) as ambiguous from gd group by case_id),
ed as (select gd.case_id, src, dst, sum(value_sats)::bigint as total, sum(round(value_sats * coalesce(taint, 0.0::double))::bigint)::bigint as tainted, max(seen) as seen,
  arg_max(ref is not null, struct_pack(a := seen, i := -edge_idx)) as dated from gd left join hc on hc.case_id = gd.case_id and hc.node = src where value_sats > 0 group by all),
ar as (select en.case_id, address, src, min(struct_pack(node := node, total := total, tainted := tainted, seen := seen, dated := dated)) as f from ed join en on en.case_id = ed.case_id and node = dst
  where not coalesce(spent, false) or held is not null group by all),
le as (select case_id, address, min(f.node) as node, count(*) as senders, sum(f.total)::bigint as moved_sats, sum(f.tainted)::bigint as sats, max(f.seen) as last_at, count(*) filter (where f.dated) as dated from ar group by all having sum(f.tainted) > 0),
ac as (select c_mktsegment as case_id, 'D' || c_custkey // 2 as address, ['planned', 'submitted', 'awaiting_response', 'completed'][c_custkey % 4 + 1] as state, {NOW} - c_custkey % 12 * 86400 as updated_at,
  case when c_custkey % 7 = 0 then {NOW} + (c_custkey % 5 - 1) * 86400 end as next_at from customer),
fu as (select case_id, address, coalesce(a.next_at, case when a.state in ('submitted', 'awaiting_response') then a.updated_at + 604800 end) as due_at
  from (select case_id, address, arg_max(struct_pack(state := state, updated_at := updated_at, next_at := next_at), struct_pack(u := updated_at, s := state)) as a from ac where state <> 'completed' group by all)),
rk as (select le.*, balance_sats, spent, held, ambiguous, due_at, greatest(0, {NOW} - last_at) / 86400 as age, case when due_at <= {NOW} then 'overdue' when due_at - {NOW} <= 172800 then 'due soon' when due_at is not null then 'scheduled' else 'not scheduled' end as urgency,
  round(100 * (least(1.0::double, log10(1 + sats / 1e8::double) / 2) * 0.35::double + greatest(0.0::double, least(1.0::double, 1 - greatest(0, {NOW} - last_at) / 86400 / 90)) * 0.2::double
    + greatest(0.0::double, dated / senders * 0.4::double + attributed * 0.4::double + reached * 0.2::double - case when ambiguous then 0.1::double else 0.0::double end) * 0.45::double))::bigint as rank
  from le join en on en.case_id = le.case_id and en.node = le.node join am on am.case_id = le.case_id left join fu on fu.case_id = le.case_id and fu.address = le.address),
ld as (select case_id, address, senders, moved_sats, sats, case when spent = false then least(sats, balance_sats) else 0 end as available_sats,
  case when spent then 'spent_at_destination' when spent is null then 'trace_boundary_unknown' else 'unspent_confirmed' end as recoverability, coalesce(held, 'Unknown') as destination, last_at,
  case when age <= 7 then 'current' when age <= 30 then 'aging' else 'stale' end as freshness, ambiguous, due_at, urgency, rank,
  least(100, rank + case urgency when 'overdue' then 15 when 'due soon' then 7 else 0 end)::bigint as schedule, case when rank >= 70 then 'High' when rank >= 40 then 'Medium' else 'Low' end as priority from rk)"""
)


def found(v):
    c, n, k = v.table("customer"), F.col("c_nationkey"), F.col("c_custkey")
    address = F.concat(F.lit("D"), F.floor(k / 2).cast("string")).alias("address")
    held = F.when(n % 4 == 0, "exchange").when(n % 4 == 3, "custodian").when(n % 4 == 1, "service")
    nodes = c.select(
        F.col("c_mktsegment").alias("case_id"), F.concat(F.lit("c"), k.cast("string")).alias("node"), address, F.lit("receiver").alias("kind"),
        F.greatest(F.lit(0), F.round(F.col("c_acctbal") * 1000).cast("long")).alias("balance_sats"), F.when(F.col("c_acctbal") < 0, True).when(n % 2 == 0, False).alias("spent"),
        F.struct(held.alias("type"), F.lit("register").alias("source"), (n % 4 != 1).alias("verified")).alias("destination"),
        F.when(n % 5 < 3, F.struct(F.when(n % 5 == 0, 0.7).alias("confidence"), F.lit("list").alias("source"), (n % 5 == 1).alias("verified"))).alias("attribution"),
        F.when(n % 3 == 0, F.struct(F.lit("desk").alias("source"), F.lit(True).alias("verified"), F.when(n > 0, NOW - n.cast("long") * 20 * R.DAY).alias("verified_at"))).alias("contact"),
    )
    links = v.g2.join(v.tx.select("txid", F.col("block_time").alias("at"), F.col("block_height").alias("height")), "txid")
    links = links.withColumn("txid", F.when(~((F.col("case_id") == "MACHINERY") & (F.col("txid") % 1000 == 1)), F.col("txid")))
    links = links.unionByName(links.filter("txid % 5 = 0").withColumn("edge_idx", F.col("edge_idx") + 1_000_000))
    state = F.element_at(F.array(*map(F.lit, ("planned", "submitted", "awaiting_response", "completed"))), (k % 4 + 1).cast("int"))
    actions = c.select(F.col("c_mktsegment").alias("case_id"), address, state.alias("state"), (NOW - k % 12 * R.DAY).alias("updated_at"), F.when(k % 7 == 0, NOW + (k % 5 - 1) * R.DAY).alias("next_at"))
    return R.recovery_leads(nodes, links, seeds(v), actions, NOW)


@query("gr_recovery_leads", "g2 tx", _LEADS + " select * from ld", kept=True)
def gr_recovery_leads(v):
    """Leads by taint; a fifth of all links are given twice, and must count once."""
    return found(v)


@query("topk_recovery_leads", "g2 tx", _LEADS + " select * from (select *, row_number() over (partition by case_id order by schedule desc, rank desc, address) as place from ld) where place <= 5", kept=True)
def topk_recovery_leads(v):
    return R.best_leads(found(v))
