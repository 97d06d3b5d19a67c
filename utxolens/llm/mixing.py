"""Mixing of sources to target weights: capped water-filling, then whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utxolens.llm.common import WORD, ordinal, staged


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, total: float, max_epochs: float, max_rounds: int = 10_000) -> float:
    """The level at which targets least(max_epochs * source_size, level * weight) add up to total (or all are at their cap).

    Each round clamps the sources that the level lifts above their cap and deals what is left to the others by weight; one
    row of sums comes back to the driver.
    """
    cap, level, clamped = F.lit(max_epochs) * F.col("source_size"), 0.0, -1
    for _ in range(max_rounds):
        above = F.lit(level) * F.col("weight") > cap
        n, rest, weight = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == clamped or not weight:
            return level if weight else float("inf")
        level, clamped = (total - rest) / weight, n
    raise RuntimeError("the water level did not settle")


def _order(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def shares(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """source, source_size, target, whole, cut for each source of sized (source, order, size).

    Documents are taken `whole` times, and once more if their order (hexadecimal) is at most `cut`. The cut is found among
    sums of 4096 parts of the order, and inside the one part that the target ends in.
    """
    sums = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    sources = staged(ordinal(sums, [F.col("source").asc_nulls_last()], "turn").withColumn("weight", turn), "weights")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, total, max_epochs)
    cap = F.lit(max_epochs) * F.col("source_size")
    sources = sources.withColumn("target", F.when(cap < F.lit(level) * F.col("weight"), cap).otherwise(F.lit(level) * F.col("weight")))
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    sources = sources.withColumn("whole", F.coalesce(F.floor(ratio), F.lit(0)).cast("long"))
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = sources.select(F.col("source").alias("s"), "source_size", "target", "whole", "rest")

    part = F.substring("order", 1, 3)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sized.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
    parts = parts.join(sources, F.col("source").eqNullSafe(F.col("s")))
    full = parts.groupBy("s").agg(F.max(F.when((F.col("rest") > 0) & (F.col("ahead") + F.col("words") <= F.col("rest")), F.concat("part", F.lit("g")))).alias("cut"))
    last = parts.filter((F.col("ahead") < F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("words"))).select("s", F.col("part").alias("p"), "ahead", "rest")
    ends = sized.join(last, F.col("source").eqNullSafe(F.col("s")) & (part == F.col("p")))
    ends = ends.groupBy("s", "p", "order", "ahead", "rest").agg(F.sum("size").alias("words"))
    inside = Window.partitionBy("s", "p").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("ahead") + F.coalesce(F.sum("words").over(inside), F.lit(0)) + F.col("words") / 2
    ends = ends.withColumn("taken", middle < F.col("rest")).filter("taken").groupBy("s").agg(F.max("order").alias("cut"))
    cuts = full.unionByName(ends).groupBy("s").agg(F.max("cut").alias("cut")).withColumnRenamed("s", "of")
    out = sources.join(cuts, F.col("s").eqNullSafe(F.col("of")), "left")
    return staged(out.select(F.col("s").alias("source"), "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut")), "shares")


def repetitions(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sized, shares): each row's doc_id, source, size and order, and what each source is taken; see taken().

    Size is the number of words; null text has none. Sources in code point order, null last, get `weights` in turn; their
    targets share `share` times all words, clamped at max_epochs times their size, the excess dealt again by weight. Every
    document is taken floor(target / source_size) times. The rest of the target comes from a seeded order of the source's
    documents, md5 of seed and doc_id: they are taken once more while the middle of the document lies under the rest, so a
    source misses its target by half a document at most. Rows of one doc_id are taken alike; a null doc_id has an order too;
    an empty table gives an empty result. Sources of any size are only summed, never gathered.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    own = staged(own.withColumn("order", _order(F.col("doc_id"), seed)), "words")
    return own, shares(own, weights, share, max_epochs)


def _repeats() -> Column:
    return F.col("whole") + F.when(F.col("order") <= F.col("cut"), 1).otherwise(0)


def mix_table(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs; see repetitions()."""
    own, plan = repetitions(docs, **how)
    plan = plan.withColumnRenamed("source", "s")
    out = own.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (_repeats() * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """docs as the mix has them: each row as many times as it is taken (rows taken zero times are not in the mix).

    Columns of any name are kept, nulls too; see repetitions() for null sources and texts. An empty table gives an empty mix.
    """
    plan = repetitions(docs, seed=seed, **how)[1].select(F.col("source").alias("s"), "whole", "cut")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").cast("string").alias("source"), _order(F.col("doc_id").cast("long"), seed).alias("order"))
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("n", _repeats().cast("int"))
    return taken.select(F.explode(F.array_repeat("_row", F.col("n"))).alias("_row")).select("_row.*")
