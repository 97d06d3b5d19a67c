"""Common-input ownership: which addresses of a pool were spent together, the clusters that makes, and how sure they are.

A pool is a set of addresses under suspicion, pool(pool_id, address); all pools are worked on at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.operators.iterate import components, settled
from utxolens.operators.transactions import entropy


def common_spends(pool: DataFrame, txi: DataFrame, txo: DataFrame) -> DataFrame:
    """Transactions that spend two or more addresses of a pool: (pool_id, txid, n_in, inputs, is_mix).

    inputs are the pool's addresses in it, each once, in order: as many as a transaction has inputs. It looks like a mix, and then
    proves no ownership, if its outputs do (entropy), or if it has five inputs, three of them the pool's, and an anonymity
    ratio over 0.8. Rows without an address or a transaction take no part.
    """
    own = pool.select("pool_id", "address").distinct()
    spent = txi.filter("txid is not null and address is not null").select("txid", "address").distinct().join(own, "address")
    joint = spent.groupBy("pool_id", "txid").agg(F.array_sort(F.collect_set("address")).alias("inputs")).filter("size(inputs) >= 2")
    sizes = txi.groupBy("txid").agg(F.count("*").alias("n_in"))
    looks = entropy(txo).select("txid", "is_coinjoin", "anonymity_milli")
    crowd = (F.col("n_in") >= 5) & (F.size("inputs") >= 3) & (F.coalesce("anonymity_milli", F.lit(0)) > 800)
    known = joint.join(sizes, "txid").join(looks, "txid", "left")
    return known.select("pool_id", "txid", "n_in", "inputs", (F.coalesce("is_coinjoin", F.lit(False)) | crowd).alias("is_mix"))


def _components(links: DataFrame) -> DataFrame:
    """(pool_id, address, cluster) of linked addresses, links(pool_id, a, b): the smallest address reached names the cluster."""
    return components(links, ["pool_id"]).select("pool_id", F.col("node").alias("address"), F.col("component").alias("cluster"))


def _stars(spends: DataFrame) -> DataFrame:
    """Links of common spends that are no mixes: each input to the transaction's smallest."""
    own = spends.filter(~F.col("is_mix")).select("pool_id", F.explode("inputs").alias("a"), F.element_at("inputs", 1).alias("b"))
    return own.filter("a != b").distinct()


def clusters(pool: DataFrame, spends: DataFrame) -> DataFrame:
    """(pool_id, address, cluster) for every address of every pool, spends from common_spends(); one never spent with another is its own."""
    found = _components(_stars(spends))
    own = pool.select("pool_id", "address").distinct().join(found, ["pool_id", "address"], "left")
    return own.withColumn("cluster", F.coalesce("cluster", "address"))


def update_clusters(labels: DataFrame, spends: DataFrame) -> DataFrame:
    """Stored labels(pool_id, address, cluster) after new common spends: the same, with moved: whether a label is new or has changed.

    The rounds run over the clusters that new spends meet, each as one node, and never over stored links; labels are read once,
    to be renamed. As the smallest address names a cluster, the result equals a run over all spends.
    """
    met = spends.filter(~F.col("is_mix")).select("pool_id", "txid", F.explode("inputs").alias("address")).join(labels, ["pool_id", "address"], "left")
    met = settled(met.withColumn("now", F.coalesce("cluster", "address")))
    least = met.groupBy("pool_id", "txid").agg(F.min("now").alias("b"))
    links = met.join(least, ["pool_id", "txid"]).select("pool_id", F.col("now").alias("a"), "b").filter("a != b").distinct()
    renamed = _components(links).select("pool_id", F.col("address").alias("cluster"), F.col("cluster").alias("better"))
    fresh = met.filter("cluster is null").select("pool_id", "address", F.col("address").alias("cluster"), F.lit(True).alias("moved")).distinct()
    rows = labels.select("pool_id", "address", "cluster", F.lit(False).alias("moved")).unionByName(fresh).join(renamed, ["pool_id", "cluster"], "left")
    better = F.col("better").isNotNull() & (F.col("better") != F.col("cluster"))
    return rows.select("pool_id", "address", F.coalesce("better", "cluster").alias("cluster"), (F.col("moved") | better).alias("moved"))


def pool_report(pool: DataFrame, spends: DataFrame, labels: DataFrame) -> DataFrame:
    """Per pool(pool_id, address, kind): addresses, groups, largest group, common spends, mixes passed over, the kind all share, confidence.

    Confidence is earned: 15 a common spend, 30 at most, above 50; a pool with none stays under 46. Three addresses add 3, and
    segwit throughout adds 4 to what spends have shown.
    """
    own = pool.groupBy("pool_id").agg(F.count_distinct("address").alias("addresses"), F.min("kind").alias("low"), F.max("kind").alias("high"), F.count_if(F.col("kind").isNull()).alias("unknown"))
    own = own.withColumn("kind", F.when((F.col("low") == F.col("high")) & (F.col("unknown") == 0), F.col("low"))).drop("low", "high", "unknown")
    sizes = labels.groupBy("pool_id", "cluster").agg(F.count("*").alias("n")).groupBy("pool_id").agg(F.count("*").alias("groups"), F.max("n").alias("largest"))
    seen = spends.groupBy("pool_id").agg(F.count_if(~F.col("is_mix")).alias("spends"), F.count_if(F.col("is_mix")).alias("mixes"))
    out = own.join(sizes, "pool_id").join(seen, "pool_id", "left").fillna(0, ["spends", "mixes"])
    three = F.when(F.col("addresses") >= 3, 3).otherwise(0)
    segwit = F.when(F.col("kind") == "segwit", 4).otherwise(0)
    earned = 50 + F.least(F.lit(30), F.col("spends") * 15) + segwit + three
    return out.withColumn("confidence", F.when(F.col("spends") > 0, earned).otherwise(30 + three).cast("long"))
