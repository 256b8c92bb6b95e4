"""Views over the shipped test tables, with names that show their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# view -> (source table, {source column: view column})
STAR = {
    "regions": ("region", {"r_regionkey": "id", "r_name": "name"}),
    "nations": ("nation", {"n_nationkey": "id", "n_name": "name", "n_regionkey": "region_id"}),
    "customers": (
        "customer",
        {"c_custkey": "id", "c_name": "name", "c_nationkey": "nation_id", "c_acctbal": "acctbal",
         "c_mktsegment": "mktsegment"},
    ),
    "suppliers": (
        "supplier",
        {"s_suppkey": "id", "s_name": "name", "s_nationkey": "nation_id", "s_acctbal": "acctbal"},
    ),
    "parts": (
        "part",
        {"p_partkey": "id", "p_name": "name", "p_brand": "brand", "p_type": "type",
         "p_size": "size", "p_retailprice": "retailprice"},
    ),
    "orders": (
        "orders",
        {"o_orderkey": "id", "o_custkey": "customer_id", "o_orderstatus": "orderstatus",
         "o_totalprice": "totalprice", "o_orderdate": "orderdate",
         "o_orderpriority": "orderpriority"},
    ),
    "lineitems": (
        "lineitem",
        {"l_orderkey": "order_id", "l_partkey": "part_id", "l_suppkey": "supplier_id",
         "l_linenumber": "linenumber", "l_quantity": "quantity",
         "l_extendedprice": "extendedprice", "l_discount": "discount", "l_tax": "tax",
         "l_returnflag": "returnflag", "l_linestatus": "linestatus", "l_shipdate": "shipdate"},
    ),
    "events": (
        "events",
        {"event_id": "id", "user_id": "customer_id", "ts": "ts", "event_type": "event_type",
         "value": "value", "props": "props"},
    ),
}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: raw_table(spark, sf_dir, name) for name in RAW}


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = {}
    for view, (source, names) in STAR.items():
        table = raw_table(spark, sf_dir, source)
        out[view] = table.select(*[F.col(old).alias(new) for old, new in names.items()])
    return out


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders seen as transfers between two customers: two keys into one table."""
    orders = raw_table(spark, sf_dir, "orders")
    bounds = raw_table(spark, sf_dir, "customer").agg(
        (F.min("c_custkey") + F.max("c_custkey")).alias("mirror")
    ).first()
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("from_customer_id"),
        (F.lit(bounds.mirror) - F.col("o_custkey")).alias("to_customer_id"),
        F.col("o_totalprice").alias("amount"),
    )
