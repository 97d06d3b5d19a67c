"""Imports and exports: address lists, case files, guarded CSV, JSON, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utxolens.operators.iterate import settled
from utxolens.sources import store


def address_rows(lines: DataFrame) -> DataFrame:
    """Rows of an address list, lines(n, value): address, tag, notes, tier, duplicate. Byte-order mark and header are skipped.

    Fields end at comma, semicolon or tab; quotes around them go; a repeated address, in any case, is a duplicate of the first.
    """
    text = F.regexp_replace("value", "^﻿", "")
    own = lines.select("n", F.transform(F.split(text, "[,;\t]"), lambda x: F.regexp_replace(F.trim(x), '^"(.*)"$', "$1")).alias("f"))
    own = own.select("n", F.get("f", F.lit(0)).alias("address"), *[F.coalesce(F.nullif(F.get("f", F.lit(i)), F.lit("")), F.lit(d)).alias(c) for i, (c, d) in enumerate((("tag", "imported"), ("notes", ""), ("tier", "unrated")), 1)])
    own = own.filter(~F.lower("address").isin("address", "wallet", "")).filter("address is not null")
    first = Window.partitionBy(F.lower("address")).orderBy("n")
    return own.withColumn("duplicate", F.row_number().over(first) > 1)


def read_address_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    return address_rows(lines)


def guarded(value: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(value.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def guarded_frame(df: DataFrame) -> DataFrame:
    return df.select([guarded(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with header; quotes are doubled and formulas guarded."""
    guarded_frame(df).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_cases(spark: SparkSession, path: str, schema: str, most: int = 50, multi_line: bool = True) -> DataFrame:
    """Cases of JSON files, one or a list in each (or, without multi_line, one in each line): without id they go, the last of an id stays, at most `most` by id."""
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path).withColumn("n", F.monotonically_increasing_id())
    last = Window.partitionBy("id").orderBy(F.desc("n"))
    own = raw.filter("id is not null").withColumn("k", F.row_number().over(last)).filter("k = 1").drop("k", "n")
    return own.orderBy("id").limit(most)


def merge_cases(raw: DataFrame, path: str, replace: bool = False, of: int = 64) -> tuple[int, int]:
    """Merge cases, raw(id, nodes, links, ...), into the store at path: (version, cases skipped). A case takes the place of the one of its id.

    A case without id, nodes or links is skipped. With replace, stored cases that raw doesn't hold go; unless no case of raw is whole,
    in which case nothing changes.
    """
    ok = F.coalesce(F.col("id") != "", F.lit(False)) & F.col("nodes").isNotNull() & F.col("links").isNotNull()
    own = settled(raw.withColumn("_ok", ok))
    good = own.filter("_ok").drop("_ok")
    skipped, spark = own.filter("NOT _ok").count(), raw.sparkSession
    gone = store.read(spark, path).select("id") if replace and store.versions(spark, path) and not good.isEmpty() else None
    return store.upsert(good, path, ["id"], gone=gone, of=of), skipped


def normalised_watchlist(entries: DataFrame, most: int = 100) -> DataFrame:
    """Watch entries (n, address, tag) trimmed, without blanks, each address once in any case, at most `most` in order."""
    own = entries.withColumn("address", F.trim("address")).filter("address != ''")
    first = Window.partitionBy(F.lower("address")).orderBy("n")
    own = own.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    return own.orderBy("n").limit(most)


def write_snapshot(df: DataFrame, path: str, captured_at: str) -> None:
    """An immutable copy of df under captured_at=; an existing one is an error."""
    df.write.mode("error").parquet(f"{path}/captured_at={captured_at}")
