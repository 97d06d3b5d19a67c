"""Graph records of transactions, unmixing, opcode counts, claims, gaps and master audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utxolens.functions import scripts as S
from utxolens.operators.iterate import settled


def graph_nodes(tx: DataFrame, txi: DataFrame, txo: DataFrame, mixes: DataFrame) -> DataFrame:
    """(txid, node_id, type, balance_sats): hub, one node per input address, one per output; a repeated output address is named by its place."""
    hub = txo.groupBy("txid").agg(F.sum("value_sats").alias("balance_sats")).join(tx.select("txid"), "txid", "left_semi").join(mixes.select("txid", F.lit("mixer").alias("m")), "txid", "left")
    hub = hub.select("txid", F.concat(F.lit("tx_"), F.col("txid").cast("string")).alias("node_id"), F.coalesce("m", F.lit("hop")).alias("type"), "balance_sats")
    ins = txi.groupBy("txid", "address").agg(F.sum("value_sats").alias("balance_sats")).select("txid", F.concat(F.lit("in_"), "address").alias("node_id"), F.lit("suspect").alias("type"), "balance_sats")
    again = F.row_number().over(Window.partitionBy("txid", "address").orderBy("vout")) > 1
    name = F.when(F.col("again"), F.concat_ws("_", F.lit("out_utxo"), F.col("txid").cast("string"), F.col("vout").cast("string"))).otherwise(F.concat(F.lit("out_"), "address"))
    outs = txo.withColumn("again", again).select("txid", name.alias("node_id"), F.when(F.col("spend_txid").isNull(), "receiver").otherwise("hop").alias("type"), "value_sats")
    return hub.unionByName(ins).unionByName(outs.withColumnRenamed("value_sats", "balance_sats"))


def opcodes(scripts: DataFrame) -> DataFrame:
    """(opcode, n): opcodes of scripts(script, hexadecimal), pushed data passed over. Null and empty scripts have none."""
    return scripts.select(F.explode(S.opcodes(F.col("script"))).alias("opcode")).groupBy("opcode").agg(F.count("*").alias("n"))


def unmix_candidates(mixes: DataFrame, txi: DataFrame, txo: DataFrame, least_fee: int, most_fee: int, most_inputs: int = 16) -> DataFrame:
    """(txid, mask, change_vout, fee): input subsets of equal-output mixes(txid, modal_sats) that pay one equal output, a change and a fee.

    2^n - 1 subsets of at most most_inputs inputs in each mix; change -1 means none. Subsets meet changes by an equi-join on
    the transaction with a range condition.
    """
    ins = txi.join(mixes.select("txid"), "txid", "left_semi").groupBy("txid").agg(F.array_sort(F.collect_list(F.struct("vin", "value_sats"))).alias("i")).filter(F.size("i") <= most_inputs)
    masks = ins.select("txid", "i", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("i")).cast("int") - 1)).alias("mask"))
    total = F.aggregate(F.transform("i", lambda x, k: F.when(F.expr("mask").bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0, x["value_sats"]).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    masks = masks.select("txid", "mask", total.alias("total")).join(mixes.select("txid", "modal_sats"), "txid")
    change = txo.join(mixes.select("txid", "modal_sats"), "txid").filter("value_sats != modal_sats").select("txid", F.col("vout").alias("change_vout"), F.col("value_sats").alias("change"))
    change = change.unionByName(mixes.select("txid", F.lit(-1).cast("long").alias("change_vout"), F.lit(0).cast("long").alias("change")))
    fee = F.col("total") - F.col("modal_sats") - F.col("change")
    return masks.join(change, "txid").withColumn("fee", fee).filter(F.col("fee").between(least_fee, most_fee)).select("txid", "mask", "change_vout", "fee")


def unmix_partitions(candidates: DataFrame, equal_outputs: DataFrame, most: int = 10, tried: DataFrame | None = None) -> DataFrame:
    """Per mix (txid, equal_outputs): solutions of as many disjoint candidates as equal outputs, the verdict and its confidence.

    Candidates join in rising order of (mask, change), so each set comes once; a change is used once. Only the count up to
    more than `most` matters: it tells unique from ambiguous. Mixes beyond tried(txid), where given, come out as untried.
    """
    own = candidates.select("txid", "mask", "change_vout").distinct()
    own = settled(own.withColumn("k", F.row_number().over(Window.partitionBy("txid").orderBy("mask", "change_vout"))))
    need = equal_outputs.select("txid", "equal_outputs")
    now = own.select("txid", F.col("mask").alias("used"), F.array("change_vout").alias("changes"), F.col("k").alias("last")).join(need, "txid").withColumn("n", F.lit(1))
    done = now.filter("n = equal_outputs")
    for _ in range(2, (need.agg(F.max("equal_outputs")).first()[0] or 1) + 1):
        step = now.filter("n < equal_outputs").join(own, "txid").filter("k > last").filter(F.col("used").bitwiseAND(F.col("mask")) == 0).filter(~F.array_contains("changes", F.col("change_vout")) | (F.col("change_vout") == -1))
        now = settled(step.select("txid", F.col("used").bitwiseOR(F.col("mask")).alias("used"), F.concat("changes", F.array("change_vout")).alias("changes"), F.col("k").alias("last"), "equal_outputs", (F.col("n") + 1).alias("n")))
        done = done.unionByName(now.filter("n = equal_outputs"))
    found = need.join(done.groupBy("txid").agg(F.count("*").alias("solutions")), "txid", "left").withColumn("solutions", F.coalesce("solutions", F.lit(0)))
    verdict = F.when(F.col("solutions") == 0, "unsolved").when(F.col("solutions") == 1, "unique").otherwise("ambiguous")
    confidence = F.when(F.col("solutions") == 0, 30).when(F.col("solutions") == 1, 92).when(F.col("solutions") <= most, 75).otherwise(55)
    if tried is not None:
        found = found.join(tried.select("txid", F.lit(True).alias("_tried")).distinct(), "txid", "left")
        verdict, confidence = F.when(F.col("_tried"), verdict).otherwise("untried"), F.when(F.col("_tried"), confidence)
    return found.select("txid", F.least("solutions", F.lit(most + 1)).alias("solutions"), verdict.alias("verdict"), confidence.cast("long").alias("confidence"))


def claims(derived: DataFrame, stored: DataFrame, reviews: DataFrame) -> DataFrame:
    """Evidence claims (case_id, id, class, seq): derived ones once by id, the last wins; stored ones all; each with its review."""
    last = Window.partitionBy("case_id", "id").orderBy(F.desc("seq"))
    one = derived.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n").withColumn("origin", F.lit("derived"))
    both = one.unionByName(stored.withColumn("origin", F.lit("investigator_entered")))
    return both.join(reviews, ["case_id", "id"], "left").select("case_id", "id", "class", "origin", F.coalesce("review", F.lit("unreviewed")).alias("review"))


# What each missing or failing piece of evidence is called, and its priority (1 first).
CASE_GAPS = {
    "origin": ("origin unknown", 1), "tx_references": ("flows without transaction", 1), "time_metadata": ("flows without time", 2), "trace_method": ("method not recorded", 2), "trace_confidence": ("confidence under 70 percent", 2),
    "all_branches": ("branches left out", 2), "full_history": ("address history incomplete", 2), "no_warnings": ("trace warnings", 2), "paths_reviewed": ("routes not reviewed", 2), "action_evidence": ("actions without evidence", 2), "followed_up": ("follow-up overdue", 1),
}
RECEIVER_GAPS = {"destination": ("destination type unknown", 1), "availability": ("availability unknown", 1), "contact": ("no verified contact", 2), "contact_fresh": ("contact over 90 days old", 2)}


def gaps(cases: DataFrame, receivers: DataFrame) -> DataFrame:
    """(case_id, subject, gap, priority): the pieces that cases(case_id, flags) and receivers(case_id, address, flags) lack.

    A flag that is false or null is a gap. A stale contact counts only where there is a contact.
    """

    def missing(df: DataFrame, rules: dict, subject) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.struct(F.lit(g).alias("gap"), F.lit(p).alias("priority"))) for c, (g, p) in rules.items()]))
        return df.select("case_id", subject.alias("subject"), F.explode(found).alias("g")).select("case_id", "subject", "g.gap", "g.priority")

    fresh = receivers.withColumn("contact_fresh", ~F.coalesce("contact", F.lit(False)) | F.coalesce("contact_fresh", F.lit(False)))
    return missing(cases, CASE_GAPS, F.lit("case")).unionByName(missing(fresh, RECEIVER_GAPS, F.col("address")))


def master_audit(checks: DataFrame) -> DataFrame:
    """Score and rating of each case from checks(case_id, value, time, taint, heuristic), each passed, failed or null for unknown."""
    parts = {"value": 35, "time": 25, "taint": 20, "heuristic": 15}  # fixed values
    lost = sum(F.when(F.col(c) == "failed", w).otherwise(0) for c, w in parts.items())
    complete = F.col("value").isNotNull() & F.col("time").isNotNull() & F.col("taint").isNotNull() & F.col("heuristic").isNotNull()
    score = F.when(complete, F.greatest(F.lit(0), 100 - lost)).cast("long")
    rating = F.when(~complete, "INCOMPLETE").when(lost > 0, "INCONSISTENT").otherwise("CONSISTENT")
    return checks.select("case_id", score.alias("score"), rating.alias("rating"))
