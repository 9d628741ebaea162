"""The raw click log -> a columnar event table partitioned by month.

The raw log arrives as gzip CSV files (one per month in the original data).
Gzip is not splittable, so each file is read by one task; the rows are then
rebalanced by month and written partitioned by ``event_month`` so that as-of and same-month filters prune whole folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DecimalType, LongType, StringType, StructField, StructType,
                               TimestampType)

# Column layout of the raw e-commerce click log.
RAW_SCHEMA = StructType([
    StructField("event_time", TimestampType()),
    StructField("event_type", StringType()),
    StructField("product_id", LongType()),
    StructField("category_id", LongType()),
    StructField("category_code", StringType()),
    StructField("brand", StringType()),
    StructField("price", DecimalType(18, 2)),
    StructField("user_id", LongType()),
    StructField("user_session", StringType()),
])


def read_raw_log(spark: SparkSession, paths: str | list[str], schema: StructType = RAW_SCHEMA,
                 header: bool = True, timestamp_format: str = "yyyy-MM-dd HH:mm:ss z") -> DataFrame:
    """Read CSV(.gz) log files with a declared schema (no inference pass)."""
    return (spark.read.schema(schema).option("header", str(header).lower())
            .option("timestampFormat", timestamp_format).option("mode", "PERMISSIVE")
            .csv(paths))


def with_event_month(df: DataFrame, time_col: str = "event_time") -> DataFrame:
    return df.withColumn("event_month", F.date_format(F.col(time_col), "yyyy-MM"))


def load_events(df: DataFrame, out_path: str) -> str:
    """Write the log as parquet partitioned by ``event_month``.

    The rebalance hint deals the rows by month and lets AQE split what is large into
    parts of the advisory partition size and put small months together, so a month
    gets as many tasks and files as its size needs.  Dynamic partition overwrite makes
    re-loading a month idempotent.
    """
    (with_event_month(df).hint("rebalance", "event_month")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_month").parquet(out_path))
    return out_path


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Columnar event scan (format is a parameter: 'parquet', or 'delta'
    when that connector is on the classpath)."""
    return spark.read.format(fmt).load(path)
