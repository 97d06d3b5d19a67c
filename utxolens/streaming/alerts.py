"""Watch-list alerts over an unconfirmed-transaction feed, as one Structured Streaming query and as its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One message: the transactions of watched addresses by address.
FEED = T.StructType([
    T.StructField("txid", T.StringType()), T.StructField("fee", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("confirmed", T.BooleanType()), T.StructField("ts", T.TimestampType()),
    T.StructField("ins", T.ArrayType(T.StructType([T.StructField("address", T.StringType()), T.StructField("value_sats", T.LongType())]))),
    T.StructField("outs", T.ArrayType(T.StructType([T.StructField("address", T.StringType()), T.StructField("value_sats", T.LongType())]))),
])


def parsed(messages: DataFrame) -> DataFrame:
    """Transactions of JSON messages (column value) in either shape: a list of transactions, or one under 'mempool' of each address."""
    one, many = T.ArrayType(FEED), T.MapType(T.StringType(), T.StructType([T.StructField("mempool", T.ArrayType(FEED))]))
    shape = T.StructType([T.StructField("address-transactions", one), T.StructField("multi-address-transactions", many)])
    m = messages.select(F.from_json("value", shape).alias("m"))
    nested = F.flatten(F.transform(F.map_values(F.col("m.`multi-address-transactions`")), lambda x: F.coalesce(x["mempool"], F.array())))
    txs = F.concat(F.coalesce(F.col("m.`address-transactions`"), F.array()), F.coalesce(nested, F.array()))
    return m.select(F.explode(txs).alias("t")).select("t.*")


#: The columns of alerts.
FOUND = "address string, tag string, txid string, ts timestamp, amount_sats long, direction string, fee_rate long"


def flows(txs: DataFrame, watched: DataFrame) -> DataFrame:
    """One row per unconfirmed valid transaction and watched address with flow: amount, direction, fee rate (rounded half up).

    Works on streams: the flow of an address is summed inside the row's own arrays, so no state is kept.
    """
    valid = txs.filter(F.col("txid").isNotNull() & ~F.coalesce("confirmed", F.lit(False)) & F.col("ts").isNotNull())
    ends = F.array_distinct(F.transform(F.concat(F.coalesce("ins", F.array()), F.coalesce("outs", F.array())), lambda x: x["address"]))
    own = valid.withColumn("address", F.explode(ends)).filter("address is not null")
    own = own.join(watched.select(F.lower("address").alias("_w"), "tag"), F.lower("address") == F.col("_w"))

    def moved(side: str):
        mine = F.filter(F.coalesce(side, F.array()), lambda x: x["address"] == F.col("address"))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["value_sats"], F.lit(0)))

    own = own.withColumn("sent", moved("ins")).withColumn("received", moved("outs")).filter("sent + received > 0")
    direction = F.when(F.col("sent") == 0, "received").when(F.col("received") == 0, "sent").otherwise("self-mixed")
    rate = F.floor(F.col("fee") / F.nullif(F.col("weight") / 4, F.lit(0)) + 0.5).cast("long")
    return own.select("address", "tag", "txid", "ts", F.greatest("sent", "received").alias("amount_sats"), direction.alias("direction"), rate.alias("fee_rate"))


def alerts(txs: DataFrame, watched: DataFrame, late: str = "1 hour") -> DataFrame:
    """flows(), each address and transaction once. On a stream, duplicates within the watermark `late` are dropped."""
    found = flows(txs, watched).withColumn("_a", F.lower("address")).withColumn("_t", F.lower("txid"))
    if txs.isStreaming:
        return found.withWatermark("ts", late).dropDuplicatesWithinWatermark(["_a", "_t"]).drop("_a", "_t")
    first = Window.partitionBy("_a", "_t").orderBy("ts")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_a", "_t", "_n")


def newest(found: DataFrame, k: int = 50) -> DataFrame:
    """The newest k alerts, ties by address and transaction."""
    return found.orderBy(F.desc("ts"), "address", "txid").limit(k)


def poll(txs: DataFrame, watched: DataFrame) -> DataFrame:
    """Each watched address with its first transaction with flow, or the state clear."""
    found = alerts(txs, watched).withColumn("_a", F.lower("address")).groupBy("_a").agg(F.min_by("txid", F.struct("ts", "txid")).alias("txid"), F.count("*").alias("txs"))
    own = watched.join(found, F.lower("address") == F.col("_a"), "left")
    return own.select("address", F.when(F.col("txid").isNull(), "clear").otherwise("activity").alias("state"), "txid", F.coalesce("txs", F.lit(0)).alias("txs"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of the alerts under path, oldest first, on any file system that Spark can write."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName()[1:]) for s in done or ())


def keep_newest(path: str, k: int = 50):
    """A foreachBatch function that keeps the newest k alerts in versioned folders under path.

    A batch that is repeated after a failure starts again from the version before it. Versions before that are removed.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _versions(spark, path) if n < epoch]
        old = spark.read.schema(batch.schema).parquet(f"{path}/v{before[-1]}") if before else batch.limit(0)
        newest(old.unionByName(batch), k).write.mode("overwrite").parquet(f"{path}/v{epoch}")
        for n in before[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}")
            gone.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(gone, True)

    return keep


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of the newest version under path; none where no batch has finished."""
    done = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{done[-1]}") if done else spark.createDataFrame([], FOUND)
