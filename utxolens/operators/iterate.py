"""Loops over DataFrames: lineage is cut by Parquet files in the shared folder, convergence is one small row."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (unset, on a local master only) a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in shared_dir() until the driver's JVM ends or dropped() is called."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = at
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete settled frames that nothing unwritten reads any more."""
    for df in frames:
        df._settled_at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df._settled_at, True)


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], mark: Callable[[DataFrame], object], max_rounds: int) -> tuple[DataFrame, int, bool]:
    """Repeat state = step(state) until mark(state) no longer changes: (state, rounds, converged)."""
    state = settled(state)
    before = mark(state)
    for done in range(1, max_rounds + 1):
        state, old = settled(step(state)), state
        dropped(old)
        now = mark(state)
        if now == before:
            return state, done, True
        before = now
    return state, max_rounds, False


def components(links: DataFrame, by: list[str], max_rounds: int = 100) -> DataFrame:
    """(by, node, component) of the ends of links(by, a, b): the smallest node that links reach. Loops and repeats don't matter.

    In each round a node points at its neighbour or itself of the smallest hash, pointers are followed twice, and links become
    links between what nodes point at. So every round works on fewer nodes and links than the one before: of any graph about half
    the nodes lead nowhere smaller. Nodes keep their pointers by round, which are then put together from the last to the first.
    """
    left = settled(links.select(*by, "a", "b").filter("a != b").distinct())
    name = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    rounds = []
    while not left.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError("components did not settle")
        both = left.unionByName(left.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        to = settled(both.groupBy(*by, F.col("a").alias("node")).agg(F.least(name("node"), F.min(name("b")))["n"].alias("to")))
        for _ in range(2):
            further = to.select(*by, F.col("node").alias("to"), F.col("to").alias("further"))
            to, old = settled(to.join(further, [*by, "to"]).select(*by, "node", F.col("further").alias("to"))), to
            dropped(old)
        rounds.append(to)
        at = lambda end: to.select(*by, F.col("node").alias(end), F.col("to").alias(f"_{end}"))
        onward = left.join(at("a"), [*by, "a"]).join(at("b"), [*by, "b"]).filter("_a != _b")
        left, old = settled(onward.select(*by, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()), left
        dropped(old)
    if not rounds:
        return left.select(*by, F.col("a").alias("node"), F.col("a").alias("component"))
    own = rounds.pop()
    while rounds:
        last = own.select(*by, F.col("node").alias("to"), F.col("to").alias("root"))
        own = settled(rounds.pop().join(last, [*by, "to"], "left").select(*by, "node", F.coalesce("root", "to").alias("to")))
    least = own.groupBy(*by, "to").agg(F.min("node").alias("component"))
    return own.join(least, [*by, "to"]).select(*by, "node", "component")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add name: the rank from 1 in a total order, by ranges of rows; only one count per range comes to the driver."""
    ranged = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    starts, at = {}, 0
    for r, n in sorted(map(tuple, ranged.groupBy("_range").count().collect())):
        starts[r], at = at, at + n
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("_range")) if starts else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, (start + inside).cast("long")).drop("_range")


def in_order(df: DataFrame, key: list[str], order: list[str], fold: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """The rows that fold yields from df's rows, a partition at a time: rows of a key follow each other in their order.

    Rows pass in Arrow batches behind a sort that spills: a task holds one batch and the fold's state, however long a key is.
    """
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        out = []
        for row in fold(r for b in batches for r in b.to_pylist()):
            out.append(row)
            if len(out) == 8192:
                yield pa.RecordBatch.from_pylist(out, schema=made)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=made)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
