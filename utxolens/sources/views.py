"""Ledger-shaped views over the given tables, in DataFrame form and as DuckDB text.

Line items are outputs, orders are transactions; an output is spent by the next order of its part.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utxolens.operators.iterate import settled

# Script kinds by key of the part, epoch of block zero.
SCRIPTS = ("p2pkh", "p2sh", "v0_p2wpkh", "v0_p2wsh", "v1_p2tr", "p2pk")
EPOCH = 788_918_400
#: Bytes of line items, as stored, that one task gets at most where the views are shuffled.
PART_BYTES = 2 << 20


class Views:
    """Lazy DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Tasks that take PART_BYTES of line items each, so that what one of them holds doesn't grow with the input."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/lineitem.parquet")
        held = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()
        return -(-held // PART_BYTES)

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """df dealt by key over parts tasks, where spark.sql.shuffle.partitions are fewer; else as it is."""
        return df.repartition(self.parts, key) if self.parts > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else df

    @cached_property
    def owned(self) -> DataFrame:
        """placed, with the transaction's entity."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        lines = self.dealt(self.table("lineitem"), "l_orderkey").withColumn("vout", (F.row_number().over(order) - 1).cast("long"))
        joined = lines.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
        script = F.element_at(F.array(*map(F.lit, SCRIPTS)), (F.col("l_partkey") % 6 + 1).cast("int"))
        return joined.select(
            F.col("l_orderkey").alias("txid"), "vout", F.concat(F.lit("A"), F.col("l_partkey").cast("string")).alias("address"), script.alias("script_type"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("value_sats"), (F.col("l_quantity").cast("long") * 1_000_000).alias("denom_sats"), (day * 144).alias("block_height"),
            F.col("o_custkey").alias("entity"),
        )

    @cached_property
    def placed(self) -> DataFrame:
        """Outputs with their transaction's day, before spending is known."""
        return self.owned.drop("entity")

    def spent(self, placed: DataFrame) -> DataFrame:
        """placed or owned, with the spend of each output, and seen: whether an earlier transaction, by height and id, paid the address."""
        nxt = Window.partitionBy("address").orderBy("block_height", "txid", "vout")
        at = F.struct("block_height", "txid")
        out = self.dealt(placed, "address").withColumn("spend_txid", F.lead("txid").over(nxt)).withColumn("spend_height", F.lead("block_height").over(nxt))
        own = F.col("spend_txid") == F.col("txid")
        out = out.withColumn("seen", F.col("address").isNotNull() & (F.min(at).over(nxt) < at))
        return out.withColumn("spend_height", F.when(~own, F.col("spend_height"))).withColumn("spend_txid", F.when(~own, F.col("spend_txid")))

    @cached_property
    def outs(self) -> DataFrame:
        """txo with seen."""
        return self.spent(self.placed)

    @cached_property
    def txo(self) -> DataFrame:
        return self.outs.drop("seen")

    @cached_property
    def txi(self) -> DataFrame:
        spent = self.dealt(self.txo.filter("spend_txid is not null"), "spend_txid")
        vin = F.row_number().over(Window.partitionBy("spend_txid").orderBy("txid", "vout")) - 1
        out = spent.select(F.col("spend_txid").alias("txid"), vin.cast("long").alias("vin"), F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), "address", "script_type", "value_sats")
        return out.withColumn("sequence", F.when((F.col("prev_txid") + F.col("vin")) % 7 == 0, 4_294_967_293).otherwise(4_294_967_295))

    @cached_property
    def tx(self) -> DataFrame:
        day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("txid"), (key * 37 % 5000 + 200).alias("fee"), (400 + 4 * (key * 13 % 900)).alias("weight"),
            (day * 144).alias("block_height"), (day * 86_400 + EPOCH).alias("block_time"), F.col("o_custkey").alias("entity"),
        )

    @cached_property
    def g1(self) -> DataFrame:
        """Edges from transaction to spending transaction."""
        return self.txo.filter("spend_txid is not null").select(F.col("txid").alias("src"), F.col("spend_txid").alias("dst"), "vout", "value_sats", "block_height", "spend_height")

    @cached_property
    def g2(self) -> DataFrame:
        """Edges supplier to order to customer, per market segment as case; edge_idx is their order."""
        cents, named = lambda c: F.round(c * 100).cast("long"), lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
        bought = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_mktsegment")
        lines = self.dealt(self.table("lineitem"), "l_orderkey").join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        sold = Window.partitionBy("o_orderkey", "c_mktsegment", "o_custkey")
        net = F.floor(cents(F.col("l_extendedprice")) * F.round(100 - F.col("l_discount") * 100).cast("long") / 100).cast("long")
        lines = lines.withColumn("net", F.sum(net).over(sold)).withColumn("line", F.row_number().over(sold.orderBy("l_suppkey")))
        one = F.struct(named("s", "l_suppkey").alias("src"), named("o", "o_orderkey").alias("dst"), cents(F.col("l_extendedprice")).alias("value_sats"))
        two = F.struct(named("o", "o_orderkey").alias("src"), named("c", "o_custkey").alias("dst"), F.col("net").alias("value_sats"))
        both = lines.select(F.col("c_mktsegment").alias("case_id"), F.col("o_orderkey").alias("txid"), F.explode(F.when(F.col("line") == 1, F.array(one, two)).otherwise(F.array(one))).alias("edge"))
        both = both.select("case_id", "edge.src", "edge.dst", "edge.value_sats", "txid")
        idx = F.row_number().over(Window.partitionBy("case_id", "src").orderBy("txid", "dst", "value_sats"))
        return both.withColumn("edge_idx", idx.cast("long"))


class Kept(Views):
    """Views whose outputs, inputs and edges are computed once and settled, for queries that read them several times."""

    @cached_property
    def outs(self) -> DataFrame:
        return settled(Views(self.spark, self.sf_dir).outs)

    @cached_property
    def txi(self) -> DataFrame:
        own = Views(self.spark, self.sf_dir)
        own.txo = self.txo
        return settled(own.txi)

    @cached_property
    def g2(self) -> DataFrame:
        return settled(Views(self.spark, self.sf_dir).g2)


_DAY = "date_diff('day', date '1995-01-01', o_orderdate::date)"

#: name: (views it needs, text)
VIEW_SQL: dict[str, tuple[list[str], str]] = {
    "placed": ([], f"""
select l_orderkey as txid, vout, 'A' || l_partkey as address, ['p2pkh', 'p2sh', 'v0_p2wpkh', 'v0_p2wsh', 'v1_p2tr', 'p2pk'][(l_partkey % 6 + 1)::int] as script_type,
       round(l_extendedprice * 100)::bigint as value_sats, l_quantity::bigint * 1000000 as denom_sats, {_DAY} * 144 as block_height
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as vout from lineitem)
join orders on l_orderkey = o_orderkey"""),
    "txo": (["placed"], """
select txid, vout, address, script_type, value_sats, denom_sats, block_height,
       case when nt <> txid then nt end as spend_txid, case when nt <> txid then nh end as spend_height
from (select *, lead(txid) over w as nt, lead(block_height) over w as nh from placed window w as (partition by address order by block_height, txid, vout))"""),
    "txi": (["txo"], """
select *, case when (prev_txid + vin) % 7 = 0 then 4294967293 else 4294967295 end as sequence
from (select spend_txid as txid, row_number() over (partition by spend_txid order by txid, vout) - 1 as vin, txid as prev_txid, vout as prev_vout,
             address, script_type, value_sats from txo where spend_txid is not null)"""),
    "tx": ([], f"""
select o_orderkey as txid, o_orderkey * 37 % 5000 + 200 as fee, 400 + 4 * (o_orderkey * 13 % 900) as weight, {_DAY} * 144 as block_height,
       {_DAY} * 86400 + {EPOCH} as block_time, o_custkey as entity from orders"""),
    "g1": (["txo"], "select txid as src, spend_txid as dst, vout, value_sats, block_height, spend_height from txo where spend_txid is not null"),
    "g2": ([], """
select *, row_number() over (partition by case_id, src order by txid, dst, value_sats) as edge_idx from (
  select c_mktsegment as case_id, 's' || l_suppkey as src, 'o' || o_orderkey as dst, round(l_extendedprice * 100)::bigint as value_sats, o_orderkey as txid
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  union all
  select c_mktsegment, 'o' || o_orderkey, 'c' || o_custkey, sum((round(l_extendedprice * 100)::bigint * round(100 - l_discount * 100)::bigint) // 100)::bigint, o_orderkey
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by c_mktsegment, o_orderkey, o_custkey)"""),
}
