"""Raw answers of a node, one JSON text a line: read against explicit schemas, judged by rules, good and rejected rows written in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# All coins there can be, the form of an identifier.
MAX_SATS = 2_100_000_000_000_000
HEX64 = "^[0-9a-fA-F]{64}$"

_BROKEN = "_corrupt_record string"
TX = f"""txid string, fee bigint, weight bigint, status struct<confirmed: boolean, block_height: bigint, block_time: bigint>,
  vin array<struct<txid: string, vout: bigint, sequence: bigint, prevout: struct<value: bigint, scriptpubkey_address: string, scriptpubkey_type: string>>>,
  vout array<struct<value: bigint, scriptpubkey_address: string, scriptpubkey_type: string>>, {_BROKEN}"""
OUTSPENDS = f"txid string, outspends array<struct<spent: boolean, txid: string, vin: bigint>>, {_BROKEN}"
_STATS = "struct<tx_count: bigint, funded_txo_count: bigint, funded_txo_sum: bigint, spent_txo_count: bigint, spent_txo_sum: bigint>"
SUMMARY = f"address string, chain_stats {_STATS}, mempool_stats {_STATS}, {_BROKEN}"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines under one of the schemas here. A line that is no JSON, or holds a value of another type, keeps its text in _corrupt_record."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def _each(items: Column, ok) -> Column:
    """Whether items is an array without nulls of which all are ok."""
    return F.coalesce(F.forall(items, lambda x: x.isNotNull() & ok(x)), F.lit(False))


def _judged(raw: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """raw with reasons, the names of the rules broken, in order; a line that could not be read has MALFORMED alone."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return raw.withColumn("reasons", F.when(F.col("_corrupt_record").isNotNull(), F.array(F.lit("MALFORMED"))).otherwise(broken))


def judged_transactions(raw: DataFrame, max_sats: int = MAX_SATS) -> DataFrame:
    """TX rows with reasons: TXID, INPUTS (no list, or an empty item), PREVOUT (the amount spent), OUTPUTS, AMOUNT, FEE, WEIGHT.

    Amounts are whole and from 0 to max_sats. Fee and weight may be missing; a weight of zero or less may not stand.
    """
    amount = lambda x: F.coalesce(x.between(0, max_sats), F.lit(False))
    listed = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull()), F.lit(False))
    return _judged(raw, {
        "TXID": F.col("txid").rlike(HEX64), "INPUTS": listed("vin"), "OUTPUTS": listed("vout"),
        "PREVOUT": F.col("vin").isNull() | F.forall("vin", lambda x: x["prevout"].isNull() | amount(x["prevout"]["value"])),
        "AMOUNT": F.col("vout").isNull() | F.forall("vout", lambda x: x.isNull() | amount(x["value"])),
        "FEE": F.col("fee").isNull() | amount(F.col("fee")), "WEIGHT": F.col("weight").isNull() | (F.col("weight") > 0),
    })


def judged_outspends(raw: DataFrame) -> DataFrame:
    """OUTSPENDS rows with reasons: TXID, SPENT (no list, or an item that doesn't say), SPENDER (spent by no transaction), VIN (negative)."""
    spender = lambda x: ~F.coalesce(x["spent"], F.lit(False)) | F.coalesce(x["txid"].rlike(HEX64), F.lit(False))
    return _judged(raw, {
        "TXID": F.col("txid").rlike(HEX64), "SPENT": _each(F.col("outspends"), lambda x: x["spent"].isNotNull()),
        "SPENDER": F.col("outspends").isNull() | F.forall("outspends", spender),
        "VIN": F.col("outspends").isNull() | F.forall("outspends", lambda x: F.coalesce(x["vin"], F.lit(0)) >= 0),
    })


def judged_summaries(raw: DataFrame) -> DataFrame:
    """SUMMARY rows with reasons: ADDRESS, CHAIN and MEMPOOL (no statistics, or a negative one)."""
    names = ("tx_count", "funded_txo_count", "funded_txo_sum", "spent_txo_count", "spent_txo_sum")
    whole = lambda c: F.col(c).isNotNull() & (F.least(*[F.coalesce(F.col(f"{c}.{n}"), F.lit(0)) for n in names]) >= 0)
    return _judged(raw, {"ADDRESS": F.coalesce(F.col("address"), F.lit("")) != "", "CHAIN": whole("chain_stats"), "MEMPOOL": whole("mempool_stats")})


def write_judged(judged: DataFrame, path: str) -> None:
    """One pass over judged rows: the good go to verdict=good under path, the others, with text and reasons, to verdict=rejected."""
    verdict = F.when(F.size("reasons") == 0, "good").otherwise("rejected")
    judged.withColumn("verdict", verdict).write.mode("error").partitionBy("verdict").parquet(path)


def read_judged(spark: SparkSession, path: str, schema: str, verdict: str) -> DataFrame:
    """The good or the rejected rows that write_judged() left under path; only their folder is read."""
    rows = spark.read.schema(f"{schema}, reasons array<string>, verdict string").parquet(path).filter(F.col("verdict") == verdict)
    return rows.drop("verdict") if verdict == "rejected" else rows.drop("verdict", "reasons", "_corrupt_record")
