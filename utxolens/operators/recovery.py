"""Recovery leads: where tainted value has come to rest, what is still there, how well it is evidenced, and when to follow up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utxolens.operators.graph import edge_taint, taint
from utxolens.operators.iterate import settled

DAY = 86_400

# States of an action that is over, and states that wait for an answer.
OVER = ("completed", "unable_to_proceed", "recovery_confirmed")
WAITING = ("submitted", "awaiting_response")


def distinct_links(links: DataFrame) -> DataFrame:
    """links(case_id, src, dst, value_sats, txid, edge_idx, ...) without repeats of a transaction's link between the same ends over the
    same value, the one of the lowest edge_idx staying; a link without txid may be a repeat or not and stays."""
    rest = [c for c in links.columns if c not in ("case_id", "src", "dst", "value_sats", "txid")]
    alone = F.when(F.col("txid").isNull(), F.col("edge_idx"))
    first = links.groupBy("case_id", "src", "dst", "value_sats", "txid", alone.alias("_alone")).agg(F.min(F.struct("edge_idx", *[c for c in rest if c != "edge_idx"])).alias("_f"))
    return first.select("case_id", "src", "dst", "value_sats", "txid", *[F.col(f"_f.{c}").alias(c) for c in rest])


def _clamped(x: Column) -> Column:
    """x between 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def arrivals(nodes: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row for each destination address of a case and sender to it, of tainted value that came to rest there.

    Destinations are nodes(case_id, node, address, kind, spent, destination, ...) that receive and send nothing on, are no suspect,
    transaction or data output, and are not known to be spent unless a verified exchange, service or custodian holds them.
    Nodes of one address are one destination, told by its least node; of a sender's flows to it the one to the least node counts.
    The newest link between two nodes stands for them. Repeated links count once; case links without txid make ambiguous true.
    """
    own = settled(distinct_links(links))
    unsure = own.groupBy("case_id").agg(F.bool_or(F.col("txid").isNull()).alias("ambiguous"))
    live = own.filter("value_sats > 0")
    named = F.when(F.col("destination.verified") & (F.col("destination.source") != ""), F.col("destination.type"))
    kept = ~F.coalesce(F.col("spent"), F.lit(False)) | F.coalesce(F.lower("held").rlike("exchange|service|custod"), F.lit(False))
    ends = nodes.withColumn("held", named).filter(~F.coalesce(F.col("kind"), F.lit("")).isin("suspect", "transaction", "tx", "op_return")).filter(kept)
    ends = ends.join(live.select("case_id", F.col("src").alias("node")).distinct(), ["case_id", "node"], "left_anti")
    newest = F.max(F.struct(F.coalesce("at", F.lit(0)), (-F.col("edge_idx")).alias("i"), "at", "txid", "height")).alias("l")
    flows = edge_taint(live, taint(live, seeds), newest)
    into = flows.withColumnRenamed("dst", "node").join(ends.select("case_id", "node", F.coalesce("address", "node").alias("address")), ["case_id", "node"])
    one = into.groupBy("case_id", "address", "src").agg(F.min(F.struct("node", "total_sats", "tainted_sats", F.col("l.at").alias("at"), F.col("l.txid").alias("txid"), F.col("l.height").alias("height"))).alias("f"))
    return one.select("case_id", "address", "src", "f.*").join(unsure, "case_id")


def follow_ups(actions: DataFrame, now: int) -> DataFrame:
    """Per (case_id, address): due and urgency of the latest of actions(case_id, address, state, updated_at, next_at) that is not over.

    Without a date of its own, one that waits for an answer is due after seven days. Ties: the later state by name.
    """
    last = F.max(F.struct(F.coalesce("updated_at", F.lit(0)), "state", "updated_at", "next_at")).alias("a")
    own = actions.filter(~F.col("state").isin(*OVER)).groupBy("case_id", "address").agg(last)
    due = F.coalesce("a.next_at", F.when(F.col("a.state").isin(*WAITING), F.col("a.updated_at") + 7 * DAY))
    urgency = F.when(F.col("due_at") <= now, "overdue").when(F.col("due_at") - now <= 2 * DAY, "due soon").when(F.col("due_at").isNotNull(), "scheduled").otherwise("not scheduled")
    return own.select("case_id", "address", due.alias("due_at")).withColumn("urgency", urgency)


def recovery_leads(nodes: DataFrame, links: DataFrame, seeds: DataFrame, actions: DataFrame, now: int) -> DataFrame:
    """Leads by case and address, ranked 0 to 100, from arrivals() and follow_ups(); only those with tainted value.

    Value is log10(1 + BTC) / 2, recency falls to zero in 90 days, evidence is two fifths transactions with height or time, two
    fifths attribution, one fifth contact, less a tenth where links are ambiguous. Only a destination known to be unspent has value
    available, at most its balance. Sums are over exact satoshis; a missing time is 'unknown' and has no recency.
    """
    dated = F.col("txid").isNotNull() & (F.coalesce(F.col("height") > 0, F.lit(False)) | F.col("at").isNotNull())
    own = arrivals(nodes, links, seeds).groupBy("case_id", "address").agg(
        F.min("node").alias("node"), F.sum("total_sats").alias("moved_sats"), F.sum("tainted_sats").alias("sats"), F.max("at").alias("last_at"),
        F.count_if(dated).alias("dated"), F.count("*").alias("senders"), F.first("ambiguous").alias("ambiguous"),
    )
    own = own.filter("sats > 0").join(nodes.drop("address", "kind"), ["case_id", "node"]).join(follow_ups(actions, now), ["case_id", "address"], "left")
    age = F.when(F.col("last_at").isNotNull(), F.greatest(F.lit(0), F.lit(now) - F.col("last_at")) / DAY)
    told, contact = F.col("attribution"), F.col("contact")
    attributed = F.coalesce(_clamped(told["confidence"]), F.when(told["verified"], 0.9), F.when(told["source"] != "", 0.4), F.lit(0.0))
    since = (F.lit(now) - contact["verified_at"]) / DAY
    reached = F.when(contact["verified"] & (contact["source"] != ""), F.when(since.isNull(), 0.5).when(since <= 90, 1.0).otherwise(0.25)).otherwise(0.0)
    evidence = F.col("dated") / F.col("senders") * 0.4 + attributed * 0.4 + reached * 0.2 - F.when(F.col("ambiguous"), 0.1).otherwise(0.0)
    value, recency = F.least(F.lit(1.0), F.log10(1 + F.col("sats") / 1e8) / 2), F.coalesce(_clamped(1 - age / 90), F.lit(0.0))
    own = own.withColumn("rank", F.round(100 * (value * 0.35 + recency * 0.2 + F.greatest(F.lit(0.0), evidence) * 0.45)).cast("long"))
    boost = F.when(F.col("urgency") == "overdue", 15).when(F.col("urgency") == "due soon", 7).otherwise(0)
    named = F.when(F.col("destination.verified") & (F.col("destination.source") != ""), F.col("destination.type"))
    return own.select(
        "case_id", "address", "senders", "moved_sats", "sats", F.when(F.col("spent") == False, F.least("sats", F.coalesce("balance_sats", F.lit(0)))).otherwise(0).alias("available_sats"),  # noqa: E712
        F.when(F.col("spent"), "spent_at_destination").when(F.col("spent").isNull(), "trace_boundary_unknown").otherwise("unspent_confirmed").alias("recoverability"),
        F.coalesce(named, F.lit("Unknown")).alias("destination"), "last_at", F.when(age.isNull(), "unknown").when(age <= 7, "current").when(age <= 30, "aging").otherwise("stale").alias("freshness"),
        "ambiguous", "due_at", F.coalesce("urgency", F.lit("not scheduled")).alias("urgency"), "rank", F.least(F.lit(100), F.col("rank") + boost).cast("long").alias("schedule"),
        F.when(F.col("rank") >= 70, "High").when(F.col("rank") >= 40, "Medium").otherwise("Low").alias("priority"),
    )


def best_leads(found: DataFrame, k: int = 5) -> DataFrame:
    """The first k leads of each case by schedule, then rank, then address, with their place."""
    order = Window.partitionBy("case_id").orderBy(F.desc("schedule"), F.desc("rank"), "address")
    return found.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k)
