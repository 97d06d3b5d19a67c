"""Helpers that the corpus operators share: staging, row keys, components, ranks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: A word is a run of anything but ASCII white space (the class that bytes.split() cuts at).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or (unset, on a local master only) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again, so that lost executors cost no recomputation.

    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = jvm_path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing unwritten needs any more, to free disk before the driver ends."""
    for df in tables:
        df._staged_at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df._staged_at, True)


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Write df as a table bucketed by keys, in the shared folder, so that joins on the keys needn't shuffle it again.

    The files go when the driver's JVM ends; the catalog forgets the table at once.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{table}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # an external table's files stay, and what was read of it keeps the buckets
    return out


def row_key(*columns: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a row; equal rows share them, nulls are allowed."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("second"), *columns).alias("k2")]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a batch of edges, and the smallest node each reaches inside the batch."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contract(batches):
    for pdf in batches:
        if len(pdf):
            node, root = _local_roots(pdf["a"].to_numpy("int64"), pdf["b"].to_numpy("int64"))
            off = node != root
            yield pd.DataFrame({"a": node[off], "b": root[off]})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), both LONG: rows (node, component), component the smallest node.

    Each batch of edges is first contracted to stars inside its task, then large-star and small-star rounds
    run as joins until the edges no longer change. Self loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    schema = "a long, b long"
    one_way = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b")
    now = staged(one_way.mapInPandas(_contract, schema).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == before or seen[0] == 0:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = now.groupBy("b").agg(F.first("b").alias("component")).select(F.col("b").alias("node"), "component")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)


def dealt_rank(df: DataFrame, groups: list[str], by: Column, name: str, buckets: int = 1024) -> DataFrame:
    """Add name: a gapless rank from 0 inside each group, ordered by the 64-bit hash `by` and cut into buckets.

    A group of any size is spread over `buckets` windows; only one count per bucket is summed up along the group. Groups
    hold no nulls.
    """
    df = df.withColumn("_by", by).withColumn("_bucket", F.pmod(F.col("_by"), F.lit(buckets)).cast("int"))
    sums = df.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = W.Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.Window.partitionBy(*groups, "_bucket").orderBy("_by")
    ranked = df.withColumn("_in", F.row_number().over(inside))
    out = ranked.join(sums, [*groups, "_bucket"])
    return out.select(*[c for c in df.columns if c[0] != "_"], (F.col("_start") + F.col("_in") - 1).alias(name))


def ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add name: the rank from 0 of each row in a total order, by ranges of rows and the counts of the ranges.

    Only one count per range comes to the driver.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    starts, at = [], 0
    for r in sorted(ranged.groupBy("_range").count().collect()):
        starts.append((r[0], at))
        at += r[1]
    start = F.lit(0)
    if starts:
        start = F.element_at(F.create_map(*[F.lit(v) for pair in starts for v in pair]), F.col("_range"))
    inside = F.row_number().over(W.Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, (start + inside - 1).cast("long")).drop("_range")
