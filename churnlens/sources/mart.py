"""Mart I/O: the tables the analytics write and read back.

The original writes every result to a SQL server and reads it back through
single-task JDBC reads.  Here a mart is a parquet folder per table under one
root (on a cluster: a shared HDFS/S3/ABFS path), written by the executors in
parallel and read back with column pruning and filter pushdown.

* ``write_mart``       S7/S8: append, overwrite, or dynamic partition overwrite
                       (re-running a snapshot replaces only its partitions,
                       where the original's append would duplicate rows).
* ``create_if_absent`` S5/S6: write each table only if it does not exist yet.
* ``read_mart``        S9: projected / filtered load (pushed to the scan).
* ``read_jdbc``        S4: partitioned JDBC read for an external SQL store.
* ``write_bucketed``   user-keyed marts bucketed for shuffle-free joins;
  ``attach_bucketed``  makes such a table known to another session.
* ``register``         S3: named temp view for SQL users.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

log = logging.getLogger(__name__)

MODES = ("append", "overwrite", "ignore", "errorifexists")


def mart_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def write_mart(df: DataFrame, root: str, name: str, mode: str = "overwrite",
               partition_by: Sequence[str] = (), dynamic: bool = True) -> str:
    """Write ``df`` as parquet table ``name`` under ``root``.

    With ``partition_by`` and mode 'overwrite', ``dynamic=True`` replaces only
    the partitions present in ``df`` (idempotent re-runs per snapshot).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    path = mart_path(root, name)
    w = df.write.mode(mode).format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
        if mode == "overwrite" and dynamic:
            w = w.option("partitionOverwriteMode", "dynamic")
    w.save(path)
    return path


def mart_exists(spark: SparkSession, root: str, name: str) -> bool:
    """True when the table can be read; any read error means 'absent'."""
    try:
        spark.read.parquet(mart_path(root, name)).schema  # noqa: B018 - resolves the files
        return True
    except AnalysisException:
        return False


def create_if_absent(tables: Mapping[str, DataFrame], root: str,
                     partition_by: Mapping[str, Sequence[str]] | None = None) -> dict[str, str]:
    """Write each table that does not exist yet; existing ones are left as
    they are.  Returns name -> 'written' | 'skipped'."""
    out = {}
    for name, df in tables.items():
        if mart_exists(df.sparkSession, root, name):
            log.info("mart %s exists, skipped", name)
            out[name] = "skipped"
            continue
        write_mart(df, root, name, mode="errorifexists", partition_by=(partition_by or {}).get(name, ()))
        out[name] = "written"
    return out


def read_mart(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None,
              where: str | None = None) -> DataFrame:
    """Projected / filtered read; both reach the parquet scan."""
    df = spark.read.parquet(mart_path(root, name))
    if columns:
        df = df.select(*columns)
    if where:
        df = df.where(where)
    return df


def read_jdbc(spark: SparkSession, url: str, table: str, properties: Mapping[str, str],
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int = 64, fetch_size: int = 10_000) -> DataFrame:
    """Read a table of an external SQL store.  With a numeric
    ``partition_column`` and bounds the read runs as ``num_partitions``
    parallel range queries instead of one task."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table) \
        .option("fetchsize", str(fetch_size))
    for k, v in properties.items():
        r = r.option(k, v)
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("partitioned JDBC reads need lower and upper bounds")
        r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower))
             .option("upperBound", str(upper)).option("numPartitions", str(num_partitions)))
    return r.load()


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None,
                   mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """Save ``df`` as a catalog table bucketed and sorted by ``key``.

    Tables bucketed the same way on the join key (e.g. the user-keyed marts
    ``monthly_rfm`` and ``monthly_churn`` by ``user_id``) join without a
    shuffle of either side.  ``path`` makes it an external table at a shared
    location.
    """
    w = df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
    return table


def attach_bucketed(spark: SparkSession, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """The table that ``write_bucketed`` saved at ``path``, made known to this session's catalog
    with its buckets, so that no catalog has to be shared between sessions."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        location = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                  f"INTO {buckets} BUCKETS LOCATION '{location}'")
    return spark.table(table)


def register(df: DataFrame, name: str) -> DataFrame:
    """S3: expose a frame to ``spark.sql`` under ``name``."""
    df.createOrReplaceTempView(name)
    return df
