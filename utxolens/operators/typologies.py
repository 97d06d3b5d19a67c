"""Laundering patterns: value bands, peel chains, sweeps and peels of case graphs, bridge exits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utxolens.functions import ledger as L
from utxolens.functions import memos as M
from utxolens.operators.iterate import in_order


def value_bands(values: DataFrame, by: list[str], least: int = 3, cap: int = 50_000_000) -> DataFrame:
    """Structuring per group `by` of values(value_sats, and optionally many_inputs): bands of near values.

    Values of at least the dust floor, in rising order, join the open band while they lie within five percent of its mean;
    a later value can never join an earlier band, so one open band is state enough. A band counts from `least` values, none
    above cap, from half a percent of the group's sum, and not if all are equal and many_inputs holds.
    """
    many = F.col("many_inputs") if "many_inputs" in values.columns else F.lit(False)
    own = values.filter(F.col("value_sats") >= L.DUST_SATS).select(*by, "value_sats", F.coalesce(many, F.lit(False)).alias("_many"))
    types = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in by)

    def fold(rows):
        for k, group in groupby(rows, key=lambda r: [r[c] for c in by]):
            n = total = low = high = 0
            several = False
            for r in group:
                v = r["value_sats"]
                if n and (v * n - total) * 20 > total:
                    yield dict(zip(by, k, strict=True), n=n, sum=total, low=low, high=high, many=several)
                    n = total = 0
                n, total, low, high, several = n + 1, total + v, low if n else v, v, several or r["_many"]
            yield dict(zip(by, k, strict=True), n=n, sum=total, low=low, high=high, many=several)

    bands = in_order(own, by, ["value_sats"], fold, f"{types}, n long, sum long, low long, high long, many boolean")
    every = Window.partitionBy(*by)
    bands = bands.withColumn("total", F.sum("sum").over(every)).withColumn("many", F.bool_or("many").over(every))
    kept = bands.filter((F.col("n") >= least) & (F.col("high") <= cap) & (F.col("sum") * 200 >= F.col("total")) & ~(F.col("many") & (F.col("low") == F.col("high"))))
    top = F.max(F.struct(F.col("n"), (-F.col("sum")).alias("neg")))
    found = kept.groupBy(*by).agg(F.count("*").alias("bands"), top.alias("top")).withColumn("largest", F.col("top.n"))
    mean = F.floor(-F.col("top.neg") / F.col("largest") + 0.5).cast("long")
    points = F.least(F.lit(55), (F.col("largest") - least + 1) * 18) + F.when(mean < cap / 2, 15).otherwise(5) + F.when(F.col("bands") > 1, 10).otherwise(0)
    return found.select(*by, "bands", "largest", mean.alias("mean_sats"), F.least(F.lit(95), 25 + points).cast("long").alias("confidence"))


def peel_chains(hops: DataFrame) -> DataFrame:
    """Peel chains per entity over hops(entity, ord, txid, values): two-way or dominant splits in time order.

    A hop whose largest output is over 1.02 times the last hop's is passed over. Confidence from two hops on. The peels of an
    entity stream through one task in their order, which keeps four numbers of it; entities run in parallel.
    """
    total, vs = F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x), F.array_sort("values")
    own = hops.filter(F.size("values") >= 2).withColumn("vs", vs).withColumn("total", total).filter("total > 0")
    own = own.withColumn("top", F.element_at("vs", -1)).withColumn("rest", F.slice("vs", 1, F.size("vs") - 1))
    two = (F.size("vs") == 2) & (F.element_at("vs", 1) * 1000 >= F.col("total") * 8) & (F.element_at("vs", 1) * 100 <= F.col("total") * 45)
    more = (F.size("vs").between(3, 5)) & (F.col("top") * 10 >= F.col("total") * 6) & F.forall("rest", lambda x: x * 10 < F.col("total") * 3) & F.exists("rest", lambda x: x >= L.DUST_SATS)
    tenths = F.floor((F.col("total") - F.col("top")) * 1000 / F.col("total") + 0.5).cast("long")
    peels = own.filter(two | more).select("entity", "ord", "txid", "top", tenths.alias("tenths"))

    def fold(rows):
        for entity, history in groupby(rows, key=lambda r: r["entity"]):
            last, n, total, falls = None, 0, 0, True
            for r in history:
                if last is None or r["top"] * 100 <= last * 102:
                    falls = falls and (last is None or r["top"] <= last)
                    last, n, total = r["top"], n + 1, total + r["tenths"]
            yield {"entity": entity, "hops": n, "sum": total, "falls": falls}

    entity = peels.schema["entity"].dataType.simpleString()
    out = in_order(peels, ["entity"], ["ord", "txid"], fold, f"entity {entity}, hops long, sum long, falls boolean").filter("hops >= 2")
    confidence = F.least(F.lit(96), 58 + F.col("hops") * 9 + F.when((F.col("hops") >= 3) & F.col("falls"), 8).otherwise(0))
    return out.select("entity", "hops", F.floor(F.col("sum") / F.col("hops")).cast("long").alias("mean_tenths"), confidence.cast("long").alias("confidence"))


def graph_sweeps(flows: DataFrame, least: int = 4) -> DataFrame:
    """Hubs of a case graph with `least` in-edges and one or two out-edges that carry four fifths of the inflow."""
    own = flows.filter((F.col("in_degree") >= least) & F.col("out_degree").between(1, 2) & (F.col("outflow") * 10 >= F.col("inflow") * 8))
    return own.select("case_id", "node", "in_degree", "inflow", "outflow", F.when(F.col("out_degree") == 1, 88).otherwise(70).cast("long").alias("confidence"))


def graph_peels(flows: DataFrame, hops: DataFrame) -> DataFrame:
    """Per case: hops (case_id, node) whose outflow is at most 1.05 times their inflow, and whether they make a peel chain."""
    own = flows.join(hops, ["case_id", "node"], "left_semi")
    ok = (F.col("outflow") > 0) & (F.col("outflow") * 100 <= F.col("inflow") * 105)
    linear = (F.col("in_degree") == 1) & (F.col("out_degree") == 1)
    out = own.groupBy("case_id").agg(F.count("*").alias("hops"), F.count_if(ok).alias("compliant"), F.count_if(linear).alias("linear"), F.sum(F.when(ok, F.col("inflow") - F.col("outflow"))).alias("peeled_sats"))
    return out.withColumn("is_peel", (F.col("compliant") >= 2) | ((F.col("linear") >= 3) & (F.col("compliant") >= F.col("linear") - 1)))


def bridge_exits(memos: DataFrame) -> DataFrame:
    """Value by protocol and chain of memos(memo, value_sats) that name a bridge."""
    own = M.with_memo(memos, "memo").filter("protocol is not null")
    return own.groupBy("protocol", "chain").agg(F.count("*").alias("memos"), F.sum("value_sats").alias("sats"), F.count_distinct("destination").alias("destinations"))


def bridge_entities(nodes: DataFrame, providers: Sequence[tuple[str, str, str, str]], labels: Sequence[str], addresses: Sequence[str]) -> DataFrame:
    """Nodes (node, address, name) of bridges: the first provider (id, pattern, name, risk) whose pattern the address, or whose id or
    name the node's name contains, in any case; else, by a word of `labels` in the name or of `addresses` in the address, a generic
    bridge of high risk under the node's own name.

    Providers are a fixed short list and become one expression: no join. A null address or name matches nothing.
    """
    address, name = F.lower(F.coalesce("address", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))
    told = lambda *parts: F.struct(*[p.alias(c) for p, c in zip(parts, ("id", "provider", "risk"), strict=True)])
    known = [F.when(address.contains(p.lower()) | name.contains(i) | name.contains(n.lower()), told(F.lit(i), F.lit(n), F.lit(r))) for i, p, n, r in providers]
    word = reduce(or_, [name.contains(w) for w in labels] + [address.contains(w) for w in addresses])
    own = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Unattributed bridge"))
    generic = F.when(word, told(F.lit("generic-bridge"), own, F.lit("high")))
    return nodes.withColumn("_b", F.coalesce(*known, generic)).filter("_b is not null").select("node", "address", "_b.id", "_b.provider", "_b.risk")


def swap_routers(nodes: DataFrame, routers: Sequence[tuple[str, str, str, str]], words: Sequence[str]) -> DataFrame:
    """Nodes (node, address, name) of swap routers or bridges: the first router (pattern, name, category, risk) whose pattern the
    address or whose name the node's name contains, in any case; else, by a word in the name, a suspected bridge under its own name.

    Routers are a fixed short list and become one expression: no join. A null address or name matches nothing.
    """
    address, name = F.lower(F.coalesce("address", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))
    told = lambda *parts: F.struct(*[p.alias(c) for p, c in zip(parts, ("router", "category", "risk"), strict=True)])
    known = [F.when(address.contains(p.lower()) | name.contains(n.lower()), told(F.lit(n), F.lit(c), F.lit(r))) for p, n, c, r in routers]
    word = F.when(reduce(or_, [name.contains(w) for w in words]), told(F.col("name"), F.lit("suspected-bridge"), F.lit("high")))
    return nodes.withColumn("_r", F.coalesce(*known, word)).filter("_r is not null").select("node", "address", "_r.router", "_r.category", "_r.risk")


def dimension_hits(addresses: DataFrame, dims: Sequence[tuple[str, ...]]) -> DataFrame:
    """(kind, key, hits): addresses(address) that contain the pattern of each dimension row (kind, key, ...), in any case."""
    text = F.lower("address")
    found = F.array_compact(F.array(*[F.when(text.contains(d[1].lower()), F.struct(F.lit(d[0]).alias("kind"), F.lit(d[1]).alias("key"))) for d in dims]))
    return addresses.select(F.explode(found).alias("d")).groupBy("d.kind", "d.key").agg(F.count("*").alias("hits"))


def entity_tags(addresses: DataFrame, entities: DataFrame) -> DataFrame:
    """Verified entity of an address by full-length match, else a tag from its form, else null."""
    known = entities.filter(F.col("verified") & (F.length("entity_address") >= 30)).select(F.lower("entity_address").alias("k"), "entity")
    known = known.groupBy("k").agg(F.min("entity").alias("entity"))
    own = addresses.join(known, F.lower("address") == F.col("k"), "left")
    form = F.when(F.col("address").startswith("3"), "script custody?").when(F.lower("address").startswith("bc1p"), "taproot custody?")
    return own.select("address", F.coalesce("entity", form).alias("tag"), F.col("entity").isNotNull().alias("verified"))


def bridge_cases(*found: DataFrame) -> DataFrame:
    """Per case: bridge hops of all sources found(case_id, address, ord, value_sats, chain), each address once in any case.

    Of an address the first source, then the lowest order, counts. The penalty is 15 a hop, 30 at most.
    """
    both = None
    for i, f in enumerate(found):
        own = f.select("case_id", F.lower("address").alias("address"), "ord", "value_sats", "chain", F.lit(i).alias("source"))
        both = own if both is None else both.unionByName(own)
    one = both.groupBy("case_id", "address").agg(F.min_by(F.struct("value_sats", "chain"), F.struct("source", "ord")).alias("f"))
    out = one.groupBy("case_id").agg(F.count("*").alias("bridges"), F.max("f.value_sats").alias("max_sats"), F.array_join(F.array_sort(F.collect_set("f.chain")), ",").alias("chains"))  # a handful of chains
    return out.withColumn("penalty", F.least(F.lit(30), F.col("bridges") * 15).cast("long"))
