"""Queries over the event feed and over imported lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from utxolens.operators import cases as C
from utxolens.operators import typologies as Y
from utxolens.operators.iterate import shared_dir
from utxolens.plans.cases import nodes
from utxolens.plans.registry import query
from utxolens.sources import dims as D
from utxolens.sources import imports as I
from utxolens.sources.views import VIEW_SQL
from utxolens.streaming import alerts as A

VIEW_SQL["feed"] = ([], """
select 'e' || (event_id % 9000) as txid, event_id, 'U' || user_id as a, 'U' || (user_id + 1) as b, abs(round(value * 100))::bigint as v, event_id % 11 = 0 as confirmed, ts, 200 + event_id % 700 as fee, 400 + event_id % 50 * 4 as weight, event_id % 3 as k from events""")
_FLOWS = """, w as (select 'u' || n as address, 'tag' || n as tag from (select unnest(range(0, 150, 10)) as n)),
f as (select txid, ts, fee, weight, a, b, v, k from feed where not confirmed),
x as (select a as address, txid, ts, fee, weight, v as sent, case when k = 2 then v else 0 end as received from f union all select b, txid, ts, fee, weight, 0, case when k = 2 then 0 else v end from f),
fl as (select x.address, tag, txid, ts, greatest(sent, received) as amount_sats, case when sent = 0 then 'received' when received = 0 then 'sent' else 'self-mixed' end as direction, floor(fee / (weight / 4) + 0.5)::bigint as fee_rate
  from x join w on w.address = lower(x.address) where sent + received > 0),
al as (select address, tag, txid, ts, amount_sats, direction, fee_rate from (select *, row_number() over (partition by lower(address), lower(txid) order by ts) as n from fl) where n = 1)"""


def feed(v):
    """Events as unconfirmed transactions: a user pays the next user, or itself; event ids beyond 9000 repeat transactions."""
    e = v.table("events")
    value = F.abs(F.round(F.col("value") * 100)).cast("long")
    name = lambda c: F.concat(F.lit("U"), c.cast("string"))
    end = lambda address: F.array(F.struct(address.alias("address"), value.alias("value_sats")))
    a, b = name(F.col("user_id")), name(F.col("user_id") + 1)
    return e.select(F.concat(F.lit("e"), (F.col("event_id") % 9000).cast("string")).alias("txid"), (200 + F.col("event_id") % 700).alias("fee"), (400 + F.col("event_id") % 50 * 4).alias("weight"), (F.col("event_id") % 11 == 0).alias("confirmed"), F.col("ts").cast("timestamp").alias("ts"), end(a).alias("ins"), F.when(F.col("event_id") % 3 == 2, end(a)).otherwise(end(b)).alias("outs"))


def watched(v):
    return v.spark.range(0, 150, 10).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("address"), F.concat(F.lit("tag"), F.col("id").cast("string")).alias("tag"))


@query("st_alerts_batch", "feed", _FLOWS + " select address, tag, txid, amount_sats, direction, fee_rate from al")
def st_alerts_batch(v):
    return A.alerts(feed(v), watched(v)).drop("ts")


@query("st_poll", "feed", _FLOWS + ", p as (select lower(address) as a, arg_min(txid, struct_pack(t := ts, x := txid)) as txid, count(*) as txs from al group by 1) select w.address, case when p.txid is null then 'clear' else 'activity' end as state, p.txid, coalesce(txs, 0) as txs from w left join p on p.a = w.address")
def st_poll(v):
    return A.poll(feed(v), watched(v))


@query("topk_alerts", "feed", _FLOWS + " select address, txid, amount_sats from al order by ts desc, address, txid limit 50")
def topk_alerts(v):
    return A.newest(A.alerts(feed(v), watched(v)), 50).select("address", "txid", "amount_sats")


def streamed(v, out: str):
    """The alert query over the feed written as files, replayed to its end; the sink folder is in the shared folder."""
    base = shared_dir(v.spark)
    root = f"{base}/stream-{uuid.uuid4().hex}"
    feed(v).write.parquet(f"{root}/in")
    stream = v.spark.readStream.schema(feed(v).schema).parquet(f"{root}/in")
    found = A.alerts(stream, watched(v), "365 days")
    writer = found.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
    if out == "newest":
        writer.foreachBatch(A.keep_newest(f"{root}/newest")).start().awaitTermination()
        return A.read_newest(v.spark, f"{root}/newest")
    writer.format("parquet").option("path", f"{root}/out").start().awaitTermination()
    return v.spark.read.parquet(f"{root}/out")


@query("st_alerts", "feed", _FLOWS + " select distinct address, txid from al")
def st_alerts(v):
    return streamed(v, "files").select("address", "txid").distinct()


@query("st_dedup", "feed", _FLOWS + " select count(*) as alerts, count(distinct lower(address) || ':' || lower(txid)) as distinct_alerts from al")
def st_dedup(v):
    key = F.concat_ws(":", F.lower("address"), F.lower("txid"))
    return streamed(v, "files").agg(F.count("*").alias("alerts"), F.count_distinct(key).alias("distinct_alerts"))


@query("st_latest", "feed", _FLOWS + " select address, txid, amount_sats from al order by ts desc, address, txid limit 50")
def st_latest(v):
    return streamed(v, "newest").select("address", "txid", "amount_sats")


@query("src_mempool", "feed", "select count(*) as txs, count(distinct txid) as distinct_txs, sum(fee)::bigint as fees from feed")
def src_mempool(v):
    own = feed(v)
    plain = own.filter("weight % 8 = 0").select(F.to_json(F.struct(F.array(F.struct(*own.columns)).alias("address-transactions"))).alias("value"))
    multi = own.filter("weight % 8 != 0").select(F.to_json(F.struct(F.create_map(F.lit("x"), F.struct(F.array(F.struct(*own.columns)).alias("mempool"))).alias("multi-address-transactions"))).alias("value"))
    return A.parsed(plain.unionByName(multi)).agg(F.count("*").alias("txs"), F.count_distinct("txid").alias("distinct_txs"), F.sum("fee").alias("fees"))


_LIST = "select p_partkey as n, case p_partkey % 4 when 0 then 'A' || p_partkey % 50 || ',tag ' || p_brand || ',\"note, x\"' when 1 then 'a' || p_partkey % 50 || ';' when 2 then '\"A' || p_partkey % 50 || '\"' || chr(9) || p_type else 'address,tag' end as value from part"


def lines(v):
    k, a = F.col("p_partkey") % 4, (F.col("p_partkey") % 50).cast("string")
    text = F.when(k == 0, F.concat(F.lit("A"), a, F.lit(",tag "), "p_brand", F.lit(",note"))).when(k == 1, F.concat(F.lit("a"), a, F.lit(";"))).when(k == 2, F.concat(F.lit('"A'), a, F.lit('"\t'), "p_type")).otherwise(F.lit("address,tag"))
    return v.table("part").select(F.col("p_partkey").alias("n"), text.alias("value"))


_ROWS = """, r as (select p_partkey as n, case when p_partkey % 4 = 1 then 'a' else 'A' end || p_partkey % 50 as address, case p_partkey % 4 when 0 then 'tag ' || p_brand when 2 then p_type else 'imported' end as tag, case when p_partkey % 4 = 0 then 'note' else '' end as notes, 'unrated' as tier from part where p_partkey % 4 <> 3)"""


@query("src_address_csv", "tx", _ROWS + " select *, row_number() over (partition by lower(address) order by n) > 1 as duplicate from r")
def src_address_csv(v):
    return I.address_rows(lines(v))


@query("topk_watchlist", "tx", _ROWS + " select n, address, tag from (select *, row_number() over (partition by lower(address) order by n) as k from r) where k = 1 order by n limit 40")
def topk_watchlist(v):
    return I.normalised_watchlist(I.address_rows(lines(v)).select("n", "address", "tag"), 40)


@query("jn_import_overlap", "case_node", ", l as (select distinct lower('A' || p_partkey % 50) as a from part where p_partkey % 4 <> 3) select case_id, address, count(*) as hits from case_node join l on l.a = lower(address) group by all")
def jn_import_overlap(v):
    listed = I.address_rows(lines(v)).filter("not duplicate").select(F.lower("address").alias("a")).distinct()
    return nodes(v).join(listed, F.lower("address") == F.col("a")).groupBy("case_id", "address").agg(F.count("*").alias("hits"))


@query("sink_csv", "tx", "select p_partkey, case when p_partkey % 3 = 0 then '''=' || p_name when p_partkey % 3 = 1 then '''-' || p_name else p_name end as name from part")
def sink_csv(v):
    k = F.col("p_partkey") % 3
    return I.guarded_frame(v.table("part").select("p_partkey", F.when(k == 0, F.concat(F.lit("="), "p_name")).when(k == 1, F.concat(F.lit("-"), "p_name")).otherwise(F.col("p_name")).alias("name")))


_CASES = """, ca as (select 'C' || c_custkey as id, c_name as title, 'Segment ' || c_mktsegment as description, s.address as suspect from customer left join case_node s on s.case_id = 'C' || c_custkey and s.type = 'suspect')"""


@query("flt_case_search", "case_node", _CASES + " select * from ca where contains(lower(id), 'a1') or contains(lower(title), 'a1') or contains(lower(description), 'a1') or contains(lower(suspect), 'a1')")
def flt_case_search(v):
    suspects = nodes(v).filter("type = 'suspect'").select(F.col("case_id").alias("id"), F.col("address").alias("suspect"))
    own = v.table("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("Segment "), "c_mktsegment").alias("description"))
    return C.search_cases(own.join(suspects, "id", "left"), "A1")


@query("flt_timeline", "case_node", """, p as (select case_id, 'flow' as kind, txid::varchar as id, block_height as t, 'Sent to ' || address as summary, txid::varchar as reference from case_node
union all select case_id, 'note', ord::varchar, block_height + 1, 'Note on ' || type, case when ord % 4 <> 0 then address end from case_node where ord % 2 = 0),
q as (select *, row_number() over (partition by case_id order by t desc nulls last, kind, id) as place from p)
select case_id, kind, id, t as "at", summary, reference, place from q where kind = 'note' and contains(lower(summary || ' ' || coalesce(reference, '')), 'hop a1')""")
def flt_timeline(v):
    n = nodes(v)
    flows = n.select("case_id", F.lit("flow").alias("kind"), F.col("txid").cast("string").alias("id"), F.col("block_height").alias("at"), F.concat(F.lit("Sent to "), "address").alias("summary"), F.col("txid").cast("string").alias("reference"))
    notes = n.filter("ord % 2 = 0").select("case_id", F.lit("note").alias("kind"), F.col("ord").cast("string").alias("id"), (F.col("block_height") + 1).alias("at"), F.concat(F.lit("Note on "), "type").alias("summary"), F.when(F.col("ord") % 4 != 0, F.col("address")).alias("reference"))
    return C.filter_timeline(C.timeline(flows, notes), " Hop A1 ", "note")


@query("flt_attribution", "case_node", "select case_id, address from case_node where type in ('suspect', 'receiver') and address is not null")
def flt_attribution(v):
    return nodes(v).filter(F.col("type").isin("suspect", "receiver") & F.col("address").isNotNull()).select("case_id", "address")


#: Starts of labelled addresses.
_STARTS = ("1Fixed", "BC1QCHG", "3Side", "bc1qthor", "1Swap", "bc1qmaya", "symbiosis", "1Suex", "3E8t", "bc1pq", "qz")
LABELLED = f"""select p_partkey as node, {list(_STARTS)}[(p_partkey % {len(_STARTS)} + 1)::int] || 'x' || p_partkey as address,
  case p_partkey % 7 when 0 then p_name || ' Cross-Chain hub' when 1 then 'my simpleswap custodial bridge' when 2 then 'Swapper ' || p_name when 3 then 'SideShift AI Router ' || p_name when 4 then 'thorchain ' || p_name else p_name end as name from part"""


def labelled(v):
    """Parts as nodes with an address and a name."""
    key, k = F.col("p_partkey"), F.col("p_partkey") % 7
    start = F.element_at(F.array(*map(F.lit, _STARTS)), (key % len(_STARTS) + 1).cast("int"))
    name = F.when(k == 0, F.concat("p_name", F.lit(" Cross-Chain hub"))).when(k == 1, "my simpleswap custodial bridge").when(k == 2, F.concat(F.lit("Swapper "), "p_name")).when(k == 3, F.concat(F.lit("SideShift AI Router "), "p_name")).when(k == 4, F.concat(F.lit("thorchain "), "p_name")).otherwise(F.col("p_name"))
    return v.table("part").select(key.alias("node"), F.concat(start, F.lit("x"), key.cast("string")).alias("address"), name.alias("name"))


def _values(rows) -> str:
    quoted = lambda x: "null" if x is None else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


@query("ref_dims", "txo", f""", n as ({LABELLED}), dm(kind, key, name, category, risk) as (values {_values(D.rows())}),
h as (select kind, key, count(*) as hits from dm join n on contains(lower(n.address), lower(key)) where kind in ('entity', 'provider', 'router') group by 1, 2
union all select 'pool', denom_sats::varchar, count(*) from txo group by 2)
select dm.*, coalesce(hits, 0) as hits from dm left join h on h.kind = dm.kind and h.key = dm.key""")
def ref_dims(v):
    """Each row of the reference dimensions with how many addresses (of pools: outputs) of the given tables it names."""
    patterns = [r for r in D.rows() if r[0] in ("entity", "provider", "router")]
    pools = v.txo.groupBy(F.lit("pool").alias("kind"), F.col("denom_sats").cast("string").alias("key")).agg(F.count("*").alias("hits"))
    hits = Y.dimension_hits(labelled(v), patterns).unionByName(pools)
    return D.frame(v.spark).join(hits, ["kind", "key"], "left").na.fill(0, ["hits"])


@query("jn_swap_router", "tx", f""", n as ({LABELLED}), ro(pattern, router, category, risk) as (values {_values(D.ROUTERS)}), rk as (select *, row_number() over () as k from ro),
h as (select node, arg_min(struct_pack(router := router, category := category, risk := risk), k) as f from n join rk on contains(lower(n.address), lower(pattern)) or contains(lower(n.name), lower(router)) group by node),
w as (select n.node, n.address, coalesce(f.router, n.name) as router, coalesce(f.category, 'suspected-bridge') as category, coalesce(f.risk, 'high') as risk from n left join h on h.node = n.node
  where f is not null or regexp_matches(lower(n.name), 'swap|bridge|cross-chain')) select * from w""")
def jn_swap_router(v):
    return Y.swap_routers(labelled(v), D.ROUTERS, D.ROUTER_WORDS)


_BRIDGES = [(i, p, n, r) for i, (p, n, _, r) in zip(D.PROVIDER_IDS, D.PROVIDERS, strict=True)]


@query("jn_bridge_entity", "tx", f""", n as ({LABELLED}), pv(id, pattern, provider, risk) as (values {_values(_BRIDGES)}), pk as (select *, row_number() over () as k from pv),
h as (select node, arg_min(struct_pack(id := id, provider := provider, risk := risk), k) as f from n join pk on contains(lower(n.address), lower(pattern)) or contains(lower(n.name), id) or contains(lower(n.name), lower(provider)) group by node)
select n.node, n.address, coalesce(f.id, 'generic-bridge') as id, coalesce(f.provider, n.name) as provider, coalesce(f.risk, 'high') as risk from n left join h on h.node = n.node
where f is not null or regexp_matches(lower(n.name), 'bridge|cross-chain|instant swap|chain-hop') or regexp_matches(lower(n.address), 'bridge|crosschain')""")
def jn_bridge_entity(v):
    return Y.bridge_entities(labelled(v), _BRIDGES, D.BRIDGE_LABELS, D.BRIDGE_ADDRESSES)


@query("win_action_fields", "tx", """, p as (select user_id as action_id, event_id as seq, case when event_id % 7 in (0, 3) then 'note ' || event_id % 4 end as e,
  case event_id % 7 when 1 then '2024-02-0' || (event_id % 3 + 1) when 3 then '' when 4 then 'soon' end as f, case when event_id % 7 in (2, 3) then 'paid ' || event_id % 2 end as o, event_id % 7 = 5 as x from events),
a as (select *, case when x then 'UNSUPPORTED_FIELDS' when f <> '' and try_cast(f as timestamp) is null then 'INVALID_DATE' end as refused from p),
l as (select *, last_value(case when refused is null then e end ignore nulls) over w as le, coalesce(last_value(case when refused is null then f end ignore nulls) over w, '') as lf, last_value(case when refused is null then o end ignore nulls) over w as lo
  from a window w as (partition by action_id order by seq rows between unbounded preceding and 1 preceding)),
c as (select *, case when refused is null then array_to_string(list_filter([case when e is not null and e is distinct from le then 'evidence' end, case when f is not null and f is distinct from lf then 'nextFollowUpAt' end, case when o is not null and o is distinct from lo then 'outcomeEvidence' end], lambda x: x is not null), ',') end as changes from l)
select action_id, seq, coalesce(refused, case when changes = '' then 'UNCHANGED' else 'UPDATED' end) as outcome, changes from c""")
def win_action_fields(v):
    i = F.col("event_id")
    k = i % 7
    tail = lambda text, m, add=0: F.concat(F.lit(text), (i % m + add).cast("string"))
    due = F.when(k == 1, tail("2024-02-0", 3, 1)).when(k == 3, "").when(k == 4, "soon")
    given = {"evidence": F.when(k.isin(0, 3), tail("note ", 4)), "nextFollowUpAt": due, "outcomeEvidence": F.when(k.isin(2, 3), tail("paid ", 2)), "state": F.when(k == 5, "closed")}
    fields = F.map_filter(F.create_map(*[c for f, x in given.items() for c in (F.lit(f), x)]), lambda _, x: x.isNotNull())
    return C.action_edits(v.table("events").select(F.col("user_id").alias("action_id"), i.alias("seq"), fields.alias("fields")))
