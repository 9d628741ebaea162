"""Readers for the driver tables and adapters onto the canonical event model.

Canonical event columns (every operator reads only these):

    user_id        bigint
    event_time     timestamp
    event_type     string   ('view' / 'cart' / 'purchase' / ...)
    price          decimal(18,2)   exact money, so sums do not depend on order
    category_id    string   (nullable)
    category_code  string   (nullable)

Adapters only rename and cast; Catalyst prunes the unused columns and pushes
filters such as ``event_type = 'purchase'`` into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVENT_PURCHASE

EVENT_COLUMNS = ("user_id", "event_time", "event_type", "price", "category_id", "category_code")
MONEY = "decimal(18,2)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def canonical(df: DataFrame) -> DataFrame:
    """Project an event-shaped frame onto the canonical columns and types."""
    cols = set(df.columns)
    t = F.col("event_time")
    if dict(df.dtypes)["event_time"] == "string":  # ISO text times, as raw logs may carry them
        t = t.cast("timestamp_ntz")
    return df.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        t.alias("event_time"),
        F.col("event_type").cast("string").alias("event_type"),
        F.col("price").cast(MONEY).alias("price"),
        (F.col("category_id") if "category_id" in cols else F.lit(None)).cast("string").alias("category_id"),
        (F.col("category_code") if "category_code" in cols else F.lit(None)).cast("string").alias("category_code"),
    )


def purchases(events: DataFrame, purchase_type: str = EVENT_PURCHASE) -> DataFrame:
    """Purchase rows only (pushed down to the scan as ``event_type = 'purchase'``)."""
    return events.where(F.col("event_type") == F.lit(purchase_type))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as purchase events: one event per order, price = order total."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("event_time"),
        F.lit(EVENT_PURCHASE).alias("event_type"),
        F.col("o_totalprice").cast(MONEY).alias("price"),
        F.lit(None).cast("string").alias("category_id"),
        F.lit(None).cast("string").alias("category_code"),
    )


def category_purchase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as categorised purchase events.

    category_id = part brand, category_code = part type, price = discounted
    line amount computed in exact decimal and rounded half-up to cents.
    Both joins are equi-joins; Spark/AQE choose the strategy from sizes.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    amount = F.round(F.col("l_extendedprice").cast(MONEY) *
                     (F.lit(1) - F.col("l_discount").cast(MONEY)), 2).cast(MONEY)
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(p, li.l_partkey == p.p_partkey)
            .select(F.col("o_custkey").alias("user_id"),
                    F.col("o_orderdate").alias("event_time"),
                    F.lit(EVENT_PURCHASE).alias("event_type"),
                    amount.alias("price"),
                    F.col("p_brand").alias("category_id"),
                    F.col("p_type").alias("category_code")))


def click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The behaviour log: ts -> event_time, value -> price, props.k -> category_id."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("ts").alias("event_time"),
        F.col("event_type"),
        F.col("value").cast(MONEY).alias("price"),
        F.get_json_object("props", "$.k").alias("category_id"),
        F.lit(None).cast("string").alias("category_code"),
    )
