"""Queries over versioned stores: cases merged by id, and two captures of every case compared part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utxolens.operators.iterate import settled
from utxolens.plans.cases import edges, links_of, nodes
from utxolens.plans.evidence import folder
from utxolens.plans.registry import query
from utxolens.sources import imports as I
from utxolens.sources import store as S

HEIGHT = 144_000
CASE = "id string, nodes array<struct<address: string, value_sats: bigint>>, links array<struct<src: string, dst: string>>"


@query("src_case_merge", "case_node", """, n as (select *, substr(case_id, 2)::bigint as k from case_node),
a as (select case_id as id, count(*) as nodes, sum(value_sats)::bigint as sats from n where k % 3 <> 0 and ord % 7 <> 0 group by case_id),
b as (select case_id as id, count(*) as nodes, sum(value_sats)::bigint as sats from n where k % 2 = 0 and k % 10 <> 0 group by case_id)
select coalesce(b.id, a.id) as id, coalesce(b.nodes, a.nodes) as nodes, coalesce(b.sats, a.sats) as sats from a full join b on a.id = b.id""")
def src_case_merge(v):
    """Cases of two files of JSON: those of the second take the place of the first's, but for cases without links."""
    k, path = F.expr("cast(substring(case_id, 2) as bigint)"), folder(v)
    linked = edges(v).groupBy("case_id").agg(F.collect_list(F.struct("src", "dst")).alias("links"))
    links = F.coalesce("links", F.array())
    files = ((nodes(v).filter((k % 3 != 0) & (F.col("ord") % 7 != 0)), links), (nodes(v).filter(k % 2 == 0), F.when(k % 10 != 0, links)))
    for own, held in files:
        cases = own.groupBy("case_id").agg(F.collect_list(F.struct("address", "value_sats")).alias("nodes")).join(linked, "case_id", "left")
        file = folder(v)
        I.write_json(cases.select(F.col("case_id").alias("id"), "nodes", held.alias("links")), file)
        I.merge_cases(v.spark.read.schema(CASE).json(file), path)
    found = S.read(v.spark, path.rstrip("+"))
    return found.select("id", F.size("nodes").cast("long").alias("nodes"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + x["value_sats"]).alias("sats"))


def captured(n: DataFrame, e: DataFrame, height: int | None) -> dict[str, tuple[list[str], DataFrame]]:
    """{part: (key, rows)} of all cases of nodes n and links e as they stood below a height: nodes, links, transactions read, warnings."""
    if height is not None:
        n, e = n.filter(F.col("block_height") < height), e.filter(F.col("dst_height") < height)
    last = F.max("ord").over(Window.partitionBy("case_id"))
    n = n.withColumn("type", F.when((F.col("ord") == last) & (F.col("ord") > 1), "receiver").otherwise(F.col("type")))
    warned = n.groupBy("case_id").agg(F.bool_or(F.col("type") == "mixer").alias("mix"), (F.count_distinct("txid") == 1).alias("short"))
    told = F.array_compact(F.array(F.when(F.col("mix"), "mixer crossed"), F.when(F.col("short"), "one transaction only")))
    return {
        "nodes": (["case_id", "ord"], n.select("case_id", "ord", "address", "type", "value_sats")),
        "links": (["case_id", "edge_idx"], e.select("case_id", "edge_idx", "src", "dst", "value_sats")),
        "manifest": (["case_id", "txid"], n.groupBy("case_id", "txid").agg(F.max("block_height").alias("block_height"), F.count("*").alias("outputs"))),
        "warnings": (["case_id", "warning"], warned.select("case_id", F.explode(told).alias("warning"))),
    }


_PART = "select '{part}' as part, case when a.case_id is null then 'added' when b.case_id is null then 'removed' when {same} then 'unchanged' else 'changed' end as change, count(*) as n from {t}a a full join {t}b b on a.case_id = b.case_id and a.{k} = b.{k} group by 2"


def _capture_sql() -> str:
    sql = ""
    for side, below in (("a", f"where block_height < {HEIGHT}"), ("b", "")):
        sql += f""", n{side} as (select case_id, ord, address, case when ord > 1 and ord = max(ord) over (partition by case_id) then 'receiver' else type end as type, value_sats, txid, block_height from case_node {below}),
l{side} as (select * from case_edge {below.replace("block_height", "dst_height")}), m{side} as (select case_id, txid, max(block_height) as h, count(*) as outputs from n{side} group by all),
w{side} as (select case_id, 'mixer crossed' as warning from n{side} group by case_id having bool_or(type = 'mixer') union all select case_id, 'one transaction only' from n{side} group by case_id having count(distinct txid) = 1)"""
    parts = (("nodes", "n", "ord", "a.address = b.address and a.type = b.type and a.value_sats = b.value_sats"), ("links", "l", "edge_idx", "a.src = b.src and a.dst = b.dst and a.value_sats = b.value_sats"),
             ("manifest", "m", "txid", "a.h = b.h and a.outputs = b.outputs"), ("warnings", "w", "warning", "true"))
    return sql + " union all ".join(_PART.format(part=p, t=t, k=k, same=same) for p, t, k, same in parts)


@query("set_snapshot_parts", "case_node case_edge", _capture_sql())
def set_snapshot_parts(v):
    """Every case as it stood below a height against all that is known: changes of nodes, links, transactions read and warnings."""
    n = settled(nodes(v).drop("script_type"))
    e, of = settled(links_of(n).drop("src_height")), max(64, v.parts)
    before, after, out = captured(n, e, HEIGHT), captured(n, e, None), None
    for part, (key, rows) in before.items():
        old, new = folder(v), folder(v)
        S.upsert(rows, old, key, of=of)
        S.upsert(after[part][1], new, key, of=of)
        one = S.change_counts(v.spark, old, 1, new, 1).select(F.lit(part).alias("part"), "change", "n")
        out = one if out is None else out.unionByName(one)
    return out
