"""Market streams derived from the test tables: a session is a year of trades or depth, a day of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import ranked

E8 = 100_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


_TIES = ["l_shipdate", "l_quantity", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, price_e8, qty_e8, side, ts_ns."""
    li = _table(spark, sf_dir, "lineitem").select(*_TIES).withColumn("session_id", F.year("l_shipdate").cast("string")).withColumn("_at", _micros("l_shipdate"))
    return ranked(li, "_at", _TIES, "seq").select(
        "session_id", "seq",
        (F.col("l_quantity").cast("long") * E8).alias("price_e8"),
        (_cents("l_extendedprice") * 1_000_000).alias("qty_e8"),
        (F.col("l_linestatus") == "O").cast("long").alias("side"),
        (_micros("l_shipdate") * 1000).alias("ts_ns"),
    )


def bookticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, bid_price_e8, bid_qty_e8, ask_price_e8, ask_qty_e8, ts_ns."""
    ev = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value").withColumn("session_id", F.date_format("ts", "yyyy-MM-dd"))
    bid = _cents("value") * 1_000_000
    return ranked(ev, "event_id", ["event_id"], "seq").select(
        "session_id", "seq", bid.alias("bid_price_e8"),
        ((F.col("user_id") % 20 + 1) * E8).cast("long").alias("bid_qty_e8"),
        (bid + (F.col("event_id") % 3 + 1) * 1_000_000).cast("long").alias("ask_price_e8"),
        ((F.col("event_id") % 10 + 1) * E8).cast("long").alias("ask_qty_e8"),
        (_micros("ts") * 1000).alias("ts_ns"),
    )


def depth_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded depth: session_id, batch, pos, ts_ns, price_e8, qty_e8, side. A batch is an order in time order; orders are
    numbered ahead of the join with their lines, which are numbered where the join has put them."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("session_id"), (_micros("o_orderdate") * 1000 + F.col("o_orderkey")).alias("ts_ns"))
    items = _table(spark, sf_dir, "lineitem")
    held = orders.join(items.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    joined = ranked(held, "ts_ns", ["ts_ns", "o_orderkey"], "batch", dense=True).join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    pos = F.row_number().over(Window.partitionBy("o_orderkey", "session_id", "ts_ns").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")).cast("long") - 1
    return joined.select(
        "session_id", "batch", pos.alias("pos"), "ts_ns",
        (F.col("l_quantity").cast("long") * E8).alias("price_e8"),
        F.when(F.col("l_returnflag") == "A", F.lit(0)).otherwise((F.col("l_suppkey") + 1) * 1_000_000).cast("long").alias("qty_e8"),
        (F.col("l_linestatus") == "O").cast("long").alias("side"),
    )


def assemble(levels: DataFrame) -> DataFrame:
    """Depth records from exploded levels: session_id, seq, ts_ns, levels."""
    item = F.struct("pos", "price_e8", "qty_e8", "side")
    grouped = levels.groupBy("session_id", F.col("batch").alias("seq")).agg(F.min("ts_ns").alias("ts_ns"), F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select("session_id", "seq", "ts_ns", F.transform("items", lambda x: F.struct(x["price_e8"].alias("price_e8"), x["qty_e8"].alias("qty_e8"), x["side"].alias("side"))).alias("levels"))


def explode_levels(records: DataFrame) -> DataFrame:
    """Exploded levels from depth records. Outer, since a filter on the size of ``levels`` would be put below what makes them and
    parse each line again for every use in it."""
    out = records.select("session_id", F.col("seq").alias("batch"), "ts_ns", F.posexplode_outer("levels").alias("pos", "level")).where("pos IS NOT NULL")
    return out.select("session_id", "batch", F.col("pos").cast("long").alias("pos"), "ts_ns", "level.price_e8", "level.qty_e8", "level.side")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "trades":
        return trades(spark, sf_dir)
    if name == "bookticker":
        return bookticker(spark, sf_dir)
    return assemble(depth_levels(spark, sf_dir))
