"""Roles of the star-schema tables in search: items, an interaction log, vectors.

Each view has the same definition in Spark (here) and as SQL text, for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings at their home supplier's place."""
    home = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    joined = read(spark, sf_dir, "part").join(home, "p_partkey").join(read(spark, sf_dir, "supplier"), "s_suppkey")
    nation, key = F.col("s_nationkey"), F.col("s_suppkey")
    return joined.select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("microcat"), F.col("p_retailprice").alias("price"), F.col("s_nationkey").cast("int").alias("loc"),
        F.concat_ws(" ", "p_brand", "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("params"), (nation * 5.0 - 60 + (key % 50) / 100.0).alias("lat"), (nation * 9.0 - 120 + (key % 70) / 100.0).alias("lon"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as choices: what was searched where, with which filters, and the item chosen."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    log = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    filters = F.when(F.col("o_orderpriority").startswith("5"), "").otherwise(F.col("c_mktsegment"))
    return log.select(F.col("p_name").alias("query_text"), F.col("c_nationkey").cast("int").alias("search_loc"), filters.alias("filters"), F.col("p_type").alias("category"), F.col("l_partkey").alias("item_id"))


ITEMS_SQL = """home as (select l_partkey pk, min(l_suppkey) sk from lineitem group by 1),
items as (select p_partkey item_id, p_name title, p_type category, p_brand microcat, p_retailprice price, s_nationkey loc,
  concat_ws(' ', p_brand, p_type, 'size', cast(p_size as varchar)) params,
  s_nationkey * 5.0e0 - 60 + (sk % 50) / 100.0e0 lat, s_nationkey * 9.0e0 - 120 + (sk % 70) / 100.0e0 lon
  from part join home on pk = p_partkey join supplier on s_suppkey = sk)"""

LOG_SQL = """log as (select p_name query_text, c_nationkey search_loc, case when o_orderpriority like '5%' then '' else c_mktsegment end filters, p_type category, l_partkey item_id
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on p_partkey = l_partkey)"""
