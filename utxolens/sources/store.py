"""A table of records with versions, on plain Parquet: upserts by key, readers that never see half a write, and comparisons of
versions that read only what differs.

Records lie in buckets by a hash of their key. A version is a manifest, one row a bucket: the folder that holds it, its number of rows
and a digest of them. An upsert writes the buckets it touches to a folder of its own and then the manifest; a version counts from the
manifest's _SUCCESS on, so a writer that dies leaves the version before. Equal digests stand for equal rows. Only manifests, of as
many rows as there are buckets, come to the driver.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from utxolens.operators.iterate import settled

_MANIFEST = "bucket int, folder string, n long, digest string"


class Version(NamedTuple):
    """A committed version: buckets is {bucket: (folder, rows, digest)} of those that hold rows."""

    number: int
    schema: StructType
    key: list[str]
    of: int
    buckets: dict[int, tuple[str, int, str]]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions under path, oldest first."""
    done, fs = _fs(spark, f"{path}/commits/version=*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(done) or ())


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The committed version of this number, or the newest; None where there is none."""
    done = versions(spark, path)
    if number is None and not done:
        return None
    number = done[-1] if number is None else number
    if number not in done:
        raise ValueError(f"no version {number} under {path}")
    rows = spark.read.schema(f"{_MANIFEST}, of int, `key` array<string>, record string").parquet(f"{path}/commits/version={number}").collect()
    head = next(r for r in rows if r["bucket"] == -1)
    schema = StructType.fromJson(json.loads(head["record"]))
    return Version(number, schema, list(head["key"]), head["of"], {r["bucket"]: (r["folder"], r["n"], r["digest"]) for r in rows if r["bucket"] >= 0})


def _bucket(key: list[str], of: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key], *[F.col(k).isNull() for k in key]), F.lit(of)).cast("int")


def _with_bucket(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("bucket", IntegerType())])


def _digest(columns: list[str]) -> Column:
    """A digest of a bag of rows: sums of two pieces of each row's SHA-256, over every column by name, nulls written out."""
    sha = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.concat_ws(":", part(1), part(16))


def _rows(spark: SparkSession, path: str, at: Version, buckets: list[int]) -> DataFrame:
    """The rows of some buckets of a version, with their bucket; other files are neither listed nor read."""
    shape = _with_bucket(at.schema)
    paths = [f"{path}/data/{at.buckets[b][0]}/bucket={b}" for b in buckets if b in at.buckets]
    if not paths:
        return spark.createDataFrame([], shape)
    folders: dict[str, list[str]] = {}
    for p in paths:
        folders.setdefault(p.rsplit("/", 1)[0], []).append(p)
    out = None
    for base, own in sorted(folders.items()):
        part = spark.read.schema(shape).option("basePath", base).parquet(*own)
        out = part if out is None else out.unionByName(part)
    return out


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The records of a committed version, the newest by default."""
    at = version(spark, path, number)
    if at is None:
        raise ValueError(f"no version under {path}")
    return _rows(spark, path, at, sorted(at.buckets)).drop("bucket")


def upsert(rows: DataFrame, path: str, key: list[str], order: list[str] | None = None, gone: DataFrame | None = None, of: int = 64) -> int:
    """Write rows into the store at path and return the new version: a record replaces the one of its key, keys of gone are removed.

    Of several rows of a key the last by order stays (by default by the text of the whole row, so that reruns agree); null keys are
    keys. `of` buckets are laid down by the first version; take as many as make a bucket fit a task. Rows for a key in both rows and
    gone stay. Other columns than the store's are an error. Two writers at once: the second to commit fails and can be repeated.
    """
    spark = rows.sparkSession
    old = version(spark, path)
    if old and (sorted(old.schema.names) != sorted(rows.columns) or old.key != key):
        raise ValueError(f"the store at {path} holds {old.schema.names} by {old.key}")
    if {"bucket", "_k", "_new"} & set(rows.columns):
        raise ValueError("bucket, _k and _new are names of the store's own")
    of, names = (old.of, old.schema.names) if old else (of, rows.columns)
    by = [F.col(c).desc_nulls_last() for c in order or []] + [F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}).desc()]
    one = lambda df, *at: df.withColumn("_k", F.row_number().over(Window.partitionBy(*at, *key).orderBy(*by))).filter("_k = 1").drop("_k")
    if old is None:  # nothing to compare with: one shuffle, by bucket, and one write
        wide = of > int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.select(names).withColumn("bucket", _bucket(key, of)).repartition(*[of] * wide, "bucket")
        return _committed(spark, path, one(dealt, "bucket"), None, key, of, rows.select(names).schema, None)
    last = one(rows.select(names))
    new = last.withColumn("bucket", _bucket(key, of)).withColumn("_new", F.lit(True))
    if gone is not None:
        out = gone.select(key).distinct().withColumn("bucket", _bucket(key, of))
        new = new.unionByName(out.alias("g").join(last.select(key).alias("l"), [F.col(f"g.{k}").eqNullSafe(F.col(f"l.{k}")) for k in key], "left_anti"), allowMissingColumns=True)
    new = settled(new)
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
    stored, mine = _rows(spark, path, old, touched).alias("s"), new.select(*key).alias("m")
    kept = stored.join(mine, [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in key], "left_anti")
    whole = kept.unionByName(new.filter("_new").drop("_new")).repartition("bucket")
    return _committed(spark, path, whole, old, key, of, old.schema, touched)


def _committed(spark: SparkSession, path: str, whole: DataFrame, old: Version | None, key: list[str], of: int, shape: StructType, touched: list[int] | None) -> int:
    """Write whole, dealt by bucket, as the new contents of the touched buckets, and then the manifest: the new version."""
    folder, names = uuid.uuid4().hex, shape.names
    whole.write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    fresh = spark.read.schema(_with_bucket(shape)).parquet(f"{path}/data/{folder}")
    found = {r["bucket"]: (folder, r["n"], r["digest"]) for r in fresh.groupBy("bucket").agg(F.count("*").alias("n"), _digest(names).alias("digest")).collect()}
    buckets = {b: x for b, x in (old.buckets if old else {}).items() if b not in touched} | found
    number = old.number + 1 if old else 1
    lines = [(-1, None, None, None, of, key, shape.json())] + [(b, *x, None, None, None) for b, x in sorted(buckets.items())]
    spark.createDataFrame(lines, f"{_MANIFEST}, of int, `key` array<string>, record string").coalesce(1).write.mode("error").parquet(f"{path}/commits/version={number}")
    return number


def differences(spark: SparkSession, path: str, a: int, other: str, b: int) -> tuple[DataFrame, int, list[int]]:
    """Version a under path against version b under other: (rows of key and change, unchanged records in buckets not read, buckets read).

    change is added, removed, changed or, for records beside such in a bucket, unchanged. Buckets of equal digest are not read.
    Values are compared one by one; a null equals a null and nothing else. Both stores need the same key, columns and buckets.
    """
    x, y = version(spark, path, a), version(spark, other, b)
    if (x.key, x.of, sorted(x.schema.names)) != (y.key, y.of, sorted(y.schema.names)):
        raise ValueError("stores of different keys, columns or numbers of buckets")
    unequal = sorted(k for k in x.buckets.keys() | y.buckets.keys() if x.buckets.get(k, ("", 0, ""))[1:] != y.buckets.get(k, ("", 0, ""))[1:])
    same = sum(x.buckets[k][1] for k in x.buckets.keys() - set(unequal))
    rest = sorted(set(x.schema.names) - set(x.key))
    side = lambda df, name: df.select(*x.key, F.struct(F.lit(True).alias("here"), *rest).alias(name))
    p, q = side(_rows(spark, path, x, unequal), "_a").alias("p"), side(_rows(spark, other, y, unequal), "_b").alias("q")
    both = p.join(q, [F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}")) for k in x.key], "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    key = [F.when(F.col("_a").isNull(), F.col(f"q.{k}")).otherwise(F.col(f"p.{k}")).alias(k) for k in x.key]
    return both.select(*key, change.alias("change")), same, unequal


def change_counts(spark: SparkSession, path: str, a: int, other: str, b: int) -> DataFrame:
    """(change, n) between two versions; unchanged includes the buckets that were not read."""
    rows, same, _ = differences(spark, path, a, other, b)
    rest = spark.createDataFrame([("unchanged", same)], "change string, n long")
    return rows.groupBy("change").agg(F.count("*").alias("n")).unionByName(rest).groupBy("change").agg(F.sum("n").alias("n")).filter("n > 0")
