"""Queries over pools of addresses: one pool for each brand of part and one for each script kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from utxolens.operators import ownership as O
from utxolens.operators.iterate import settled
from utxolens.plans.registry import query
from utxolens.plans.transactions import _DENOM, _ENTROPY, denom
from utxolens.sources.views import SCRIPTS

# The family of each script kind, in the order of SCRIPTS.
KINDS = ("legacy", "script", "segwit", "segwit", "segwit", "other")
_NTH = "[{}][(p_partkey % 6 + 1)::int]"
_SPENDS = f"""
, own as (select *, 'A' || p_partkey as address, {_NTH.format(", ".join(map(repr, SCRIPTS)))} as script, {_NTH.format(", ".join(map(repr, KINDS)))} as kind from part),
pool as (select 'brand ' || p_brand as pool_id, address, kind from own union all select 'script ' || script, address, kind from own),
fm as ({_DENOM}), em as ({_ENTROPY.format(t="fm")}), ni as (select txid, count(*) as n_in from txi group by txid),
js as (select pool_id, txid, list_sort(list(distinct i.address)) as inputs from txi i join pool p on p.address = i.address group by pool_id, txid having count(distinct i.address) >= 2),
co as (select pool_id, js.txid, n_in, inputs, coalesce(is_coinjoin, false) or (n_in >= 5 and len(inputs) >= 3 and coalesce(anonymity_milli, 0) > 800) as is_mix
  from js join ni on ni.txid = js.txid left join em on em.txid = js.txid)"""
_LABELS = """
, st as (select distinct pool_id, unnest(inputs) as a, inputs[1] as b from co where not is_mix), ln as (select * from st union select pool_id, b, a from st),
rc as (select pool_id, address, address as c from pool union select ln.pool_id, ln.b, rc.c from rc join ln on ln.pool_id = rc.pool_id and ln.a = rc.address),
lb as (select pool_id, address, min(c) as cluster from rc group by pool_id, address)"""


def pools(v):
    nth = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int"))
    own = v.table("part").select("p_brand", F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("address"), nth(SCRIPTS).alias("script"), nth(KINDS).alias("kind"))
    named = lambda word, c: own.select(F.concat(F.lit(word), F.col(c)).alias("pool_id"), "address", "kind")
    return named("brand ", "p_brand").unionByName(named("script ", "script"))


def spends(v):
    return O.common_spends(pools(v), v.txi, denom(v))


@query("gr_common_spends", "txo txi", _SPENDS + "select pool_id, txid, n_in, array_to_string(inputs, ',') as inputs, is_mix from co", kept=True)
def gr_common_spends(v):
    return spends(v).withColumn("inputs", F.array_join("inputs", ","))


@query("gr_clusters", "txo txi", _SPENDS + _LABELS + "select * from lb", kept=True)
def gr_clusters(v):
    return O.clusters(pools(v), spends(v))


@query("gr_cluster_report", "txo txi", _SPENDS + _LABELS + """
, sz as (select pool_id, count(*) as groups, max(n) as largest from (select pool_id, cluster, count(*) as n from lb group by all) group by pool_id),
sn as (select pool_id, count(*) filter (where not is_mix) as spends, count(*) filter (where is_mix) as mixes from co group by pool_id),
ow as (select pool_id, count(distinct address) as addresses, case when count(distinct kind) = 1 then min(kind) end as kind from pool group by pool_id)
select ow.*, groups, largest, coalesce(spends, 0) as spends, coalesce(mixes, 0) as mixes, (case when addresses >= 3 then 3 else 0 end
  + case when coalesce(spends, 0) = 0 then 30 else 50 + least(30, spends * 15) + case when kind = 'segwit' then 4 else 0 end end)::bigint as confidence
from ow join sz on sz.pool_id = ow.pool_id left join sn on sn.pool_id = ow.pool_id""", kept=True)
def gr_cluster_report(v):
    found = settled(spends(v))
    return O.pool_report(pools(v), found, O.clusters(pools(v), found))


@query("gr_clusters_update", "txo txi", _SPENDS + _LABELS + "select * from lb", kept=True)
def gr_clusters_update(v):
    """Labels of transactions before block zero, brought up to date with those from it on."""
    found = settled(spends(v).join(v.tx.select("txid", "block_height"), "txid"))
    stored = O.clusters(pools(v), found.filter("block_height < 0"))
    return O.update_clusters(stored, found.filter("block_height >= 0")).drop("moved")
