"""Incremental form of the log loader (S2) with Structured Streaming.

New raw log files dropped into a folder are picked up exactly once (the file
source tracks them in the checkpoint) and appended to the month-partitioned
event table.  ``trigger(availableNow=True)`` processes what is there and
stops, so the same job runs as a scheduled batch or continuously.  The
analytics themselves are batch (snapshot) jobs and read the table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.logs import RAW_SCHEMA, with_event_month


def ingest_log_stream(spark: SparkSession, src_dir: str, out_path: str, checkpoint: str,
                      schema: StructType = RAW_SCHEMA, header: bool = True,
                      timestamp_format: str = "yyyy-MM-dd HH:mm:ss z",
                      max_files_per_trigger: int = 64, available_now: bool = True) -> StreamingQuery:
    """Start the ingest query; the caller awaits or stops it.

    ``checkpoint`` must be a shared, reliable folder on a cluster (it records
    which files were committed, so a restarted job neither skips nor repeats).
    """
    stream = (spark.readStream.schema(schema).option("header", str(header).lower())
              .option("timestampFormat", timestamp_format)
              .option("maxFilesPerTrigger", str(max_files_per_trigger))
              .csv(src_dir))
    writer = (with_event_month(stream).writeStream.format("parquet")
              .option("path", out_path).option("checkpointLocation", checkpoint)
              .partitionBy("event_month").outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
