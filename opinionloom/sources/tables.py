"""The relational test tables, seen as reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionloom.session import spread


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_facts(spark: SparkSession, folder: str, names: bool) -> DataFrame:
    """Rating, date and model label per order; with ``names`` also the customer and the first part of the order.

    The wide review text joins this table once, on the order key. Everything keyed otherwise is joined here, while
    rows are narrow.
    """
    orders = read_table(spark, folder, "orders")
    facts = orders.select(
        F.col("o_orderkey").alias("review_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        F.col("o_orderdate").cast("timestamp").alias("review_date"),
        F.when(F.col("o_orderstatus") == "F", "negative").otherwise("positive").alias("model_label"),
        "o_custkey",
    )
    if not names:
        return facts.drop("o_custkey")
    customers = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("reviewer")
    )
    parts = read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("part_key"), F.col("p_name").alias("product_name")
    )
    first_part = (
        read_table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("review_id"))
        .agg(F.min("l_partkey").alias("part_key"))
        .join(parts, "part_key", "left")
        .drop("part_key")
    )
    return facts.join(customers, "o_custkey", "left").drop("o_custkey").join(first_part, "review_id", "left")


def reviews(spark: SparkSession, folder: str, names: bool = False) -> DataFrame:
    """One review per document, with stand-ins for topic and classifier columns."""
    documents = spread(read_table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("review_text"),
        F.col("source").alias("review_title"),
        F.col("lang").alias("topic_label"),
        (
            F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2)
            .when(F.col("lang") == "fr", 3)
        ).alias("dominant_topic"),
    )
    return documents.join(order_facts(spark, folder, names), "review_id")
