"""Session helpers: a local session for tests/bench and the checkpoint-dir rule.

On a cluster the session is built by the platform; this module only reads its
settings.  ``ensure_checkpoint_dir`` follows one rule: use the shared folder the
cluster names in ``spark.checkpoint.dir``; only a local-mode session without
that setting gets a scratch folder of its own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "churnlens", extra: dict[str, str] | None = None) -> SparkSession:
    """Session used by tests and bench (local mode, UI off, UTC).  ``extra``
    adds settings, e.g. an event log folder for stage and task times."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHURNLENS_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # min/max of the event time for the snapshot calendar come from parquet footers
        .config("spark.sql.parquet.aggregatePushdown", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it only where it is unset.

    Order: the SparkContext's current dir, then ``spark.checkpoint.dir`` from the
    session conf.  A machine-local scratch folder is created only in local mode;
    a cluster session without a shared checkpoint folder is an error, because a
    local folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) sessions: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc._jsc.getCheckpointDir()
    if current.isPresent():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a shared (HDFS/S3/ABFS) folder is "
            "required on a cluster")
    path = tempfile.mkdtemp(prefix="churnlens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path
